"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.common import in_small_batches, slices, without

#: In the order of the result.  The first four are found by pattern and check alone.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
_LEAST = 0.5
_NEAR = 48
_WORDS = {
    "email": r"e-?mail|contact|write|kontakt|correo|courriel",
    "ip": r"ip|host|server|address|adresse|client",
    "card": r"card|visa|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|tel|call|mobile|fax|telefon|llame|appelez",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "ssn": r"ssn|social|security|sozialversicherung|seguro|sécurité",
}
_CONTEXT = {kind: re.compile(rf"\b(?:{words})\b", re.I) for kind, words in _WORDS.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match cannot start inside a run of digits: if the run fails, so does its rest.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Check digits of an IBAN without blanks."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches, in linear time: a local part is what stands before an @."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ibans(text: str) -> Iterable[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        code = m.group()
        while len(code) >= 15:
            packed = code.replace(" ", "")
            if 15 <= len(packed) <= 34 and mod97(packed):
                yield m.start(), m.start() + len(code)
                break
            code = code.rpartition(" ")[0]  # a word behind it may have been taken in


def _proposed(text: str) -> Iterable[tuple[str, int, int]]:
    """Spans that their pattern and their checks accept, by kind, then start."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _only_digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m.group())) <= 15:
                yield "phone", *m.span()
    yield from (("iban", a, b) for a, b in _ibans(text))
    yield from (("ssn", *m.span()) for m in _SSN.finditer(text))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the personal data in a text, in code points, end exclusive.

    E-mail and IP addresses, card and telephone numbers are always kept when
    their checks hold; IBANs (mod 97) and social security numbers need a score
    of 0.5, which a fitting word nearby raises by 0.3.
    """
    found = []
    for kind, start, end in _proposed(text or ""):
        near = text[max(0, start - _NEAR) : start] + " " + text[end : end + _NEAR]
        score = min(1.0, _START[kind] + 0.3 * bool(_CONTEXT[kind].search(near)))
        if kind in BASE or score >= _LEAST:
            found.append((kind, start, end, score))
    return found


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Replace every span by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def personal_data(
    docs: DataFrame, text_col: str = "text", spans_col: str = "spans", redacted_col: str | None = None
) -> DataFrame:
    """All columns of ``docs``, the spans found, and the redacted text when a name is given; no shuffle.

    NULL and empty texts have no spans; a NULL text stays NULL.  Columns of
    ``docs`` with the new names are replaced.
    """
    new = [spans_col, *([redacted_col] if redacted_col else [])]
    docs = without(in_small_batches(docs), [n for n in new if n != text_col])
    replaces = redacted_col == text_col
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                found = [find(text) for text in texts]
                rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans] for spans in found]
                columns = [*part.columns, pa.array(rows, kind)]
                names = [*part.schema.names, spans_col]
                if redacted_col:
                    clean = pa.array([redact(t, s) if s else t for t, s in zip(texts, found)], pa.string())
                    if replaces:
                        columns[at] = clean
                    else:
                        columns, names = [*columns, clean], [*names, redacted_col]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{spans_col}` array<{SPAN}>"
    if redacted_col and not replaces:
        schema += f", `{redacted_col}` string"
    return docs.mapInArrow(run, schema)


def span_list(spans: str, kinds: Iterable[str] = KINDS):
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    wanted = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(
        f"array_join(transform(filter({spans}, s -> s.kind in ({wanted})), "
        "s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    )
