"""Fixtures and brute-force versions for the text operators."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, label int, bucket string, `key` string, spans string, `a b` int"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(pairs):
    """Rows of SCHEMA for (doc_id, text, lang) triples; the other columns clash with names the operators use."""
    return [
        (doc, text, lang, "src", None if text is None else len(text), "x", 1, None, "k", "s", 0)
        for doc, text, lang in pairs
    ]


def sentences(seed: int, words: int, letters: str = "abcdefgh") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(words))


def corpus():
    """Texts with copies, near copies, shared passages, and every odd case; (doc_id, text, lang)."""
    base = [sentences(i, 130) for i in range(12)]
    passage = sentences(99, 80)
    long = sentences(7, 30_000)
    out = [(i, text, "en") for i, text in enumerate(base)]
    out += [(20 + i, base[0], "en") for i in range(5)]  # copies
    out += [(30 + i, base[1] + f" tail{i}", "en") for i in range(4)]  # near copies
    out += [(40 + i, f"{sentences(200 + i, 40)} {passage} {sentences(300 + i, 40)}", "fr") for i in range(6)]
    out += [(50, None, "en"), (51, "", "en"), (52, " \t\n\x0b ", None), (53, "one", "fr"), (54, "one two", "fr")]
    out += [(55, long, "en"), (56, "xx " + long, None), (57, "a" * 3000, "en"), (58, "ab " * 2000, "en")]
    out += [(59, "Ä ö   \x85 naïve 𝒳 é é", "fr"), (60, "!!! ... 123", "en")]
    out += [(3, base[3], "en"), (3, base[3], "en")]  # repeated rows
    out += [(61, passage + " " + passage, "fr")]
    return out


def words(text) -> list[str]:
    return WORD.findall(text or "")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def slow_fingerprint(text) -> int:
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(lower)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: dict) -> dict:
    """Smallest id reachable over fingerprints that differ in three bits or fewer."""
    label = {doc: doc for doc in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    return label


def slow_windows(rows, width=50) -> dict:
    first: dict = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(doc, first.get(k, doc))
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        out[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def slow_strings(rows, width=100) -> dict:
    seen, out = set(), {}
    for doc, text in sorted(set((d, t or "") for d, t in rows)):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if data[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(data[i : i + width])
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out
