"""One query per operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.llm import (
    codes,
    contamination,
    language,
    mixing,
    nearest,
    packing,
    personal,
    simhash,
    substrings,
    suffixes,
    tokens,
    toxicity,
    variants,
)
from riverspark.llm.common import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query under ``name``; ``sql`` computes the same rows in DuckDB."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""


@register(
    "op2_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    dn AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
    bn AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5),
    ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dn),
    bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM bn),
    q AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
    p AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
    FROM p JOIN q USING (item_id) WHERE 5 * shared >= 4 * item_shingles
    """,
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
        for kind in personal.BASE
    ]
    base = F.sha2(personal.span_list("spans", personal.BASE), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, personal.span_list("spans").alias("spans"))


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_limits(tokens.length_histogram(table(spark, sf_dir, "documents")))


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 5)
    known = toxicity.labelled_texts(docs.filter(fold != 0), table(spark, sf_dir, "labels"))
    scorer = toxicity.train(known.filter(fold != 4), known.filter(fold == 4))
    scored = toxicity.score_texts(docs.select("doc_id", "text"), scorer)
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


@register("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), learned_languages(docs)).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


def learned_languages(docs: DataFrame) -> language.Identifier:
    """Learn from the rows of ``documents`` outside fold 2 of 4."""
    learned = docs.filter(fold_of(F.col("doc_id"), 4) != 2)
    return language.train(learned.select("text", F.col("lang").alias("label")))


@register("op10_nearest")
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def _assigned_sql(name: str, books: str) -> str:
    """The nearest entry of every part: smallest squared distance, then lowest entry."""
    return f"""{name} AS (SELECT DISTINCT ON (r, p) r, p, x, e, d FROM (
        SELECT r, p, c.x AS x, e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut c JOIN {books} b USING (p)) ORDER BY r, p, d, e)"""


def _refined_sql(name: str, books: str, assigned: str) -> str:
    """Floors of the means of the parts of each entry; entries without parts stay."""
    return f"""{name}_m AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS c
        FROM {assigned}, unnest(range(1, 1 + len(x))) AS t(i) GROUP BY p, e, i),
    {name}_l AS (SELECT p, e, list((s - (s % c + c) % c) // c ORDER BY i) AS x FROM {name}_m GROUP BY p, e),
    {name} AS (SELECT b.p, b.e, coalesce(l.x, b.x) AS x FROM {books} b LEFT JOIN {name}_l l ON l.p = b.p AND l.e = b.e)"""


@register(
    "op11_vector_codes",
    f"""
    WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
        list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    cut AS (SELECT r, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM kept, range(16) AS t(p)),
    b0 AS (SELECT p, r - 1 AS e, x FROM cut WHERE r <= 64),
    {_assigned_sql("a0", "b0")}, {_refined_sql("b1", "b0", "a0")},
    {_assigned_sql("a1", "b1")}, {_refined_sql("b2", "b1", "a1")},
    {_assigned_sql("a2", "b2")},
    books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
    coded AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
        FROM a2 GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), books
    """,
)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@register(
    "op12_mixing",
    """
    WITH docs AS (SELECT doc_id, source, coalesce(md5(text), '') AS t,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    drawn AS (SELECT doc_id, source, size, md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), t,
        row_number() OVER (PARTITION BY doc_id, source, t) - 1)) AS draw FROM docs),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
    weighed AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources),
    before AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
        coalesce(sum(3 * source_size) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS w_before
        FROM weighed WINDOW o AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (SELECT *, (total - full_before) / (all_w - w_before) AS level FROM before),
    chosen AS (SELECT coalesce(min_by(level, w_before) FILTER (level * w < 3 * source_size), 0) AS level FROM levels),
    goals AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * chosen.level) AS target FROM weighed, chosen),
    parts AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS copies
        FROM goals),
    rest AS (SELECT *, target - copies * source_size AS budget FROM parts),
    odds AS (SELECT d.*, source_size, target, copies, budget,
        (('0x' || draw[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u,
        CASE WHEN budget > 0 THEN budget / source_size END AS chance
        FROM drawn d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source),
    ranked AS (SELECT *, u / (1 - u) / (chance / (1 - chance)) AS q FROM odds),
    ordered AS (SELECT *, least(floor(q / (1 + q) * 4503599627370496::DOUBLE), 4503599627370495) AS place FROM ranked),
    summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, draw ROWS UNBOUNDED PRECEDING) AS until
        FROM ordered)
    SELECT doc_id, size, source_size, target,
        (size * (copies + CASE WHEN 2 * until - size <= 2 * budget AND chance IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM summed
    """,
)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The reversed polynomial of crc32, a fixed value.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"


def _crc_sql(data: str, table: str) -> str:
    """crc32 of a text's UTF-8 bytes, by a table of 256 numbers."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        range(1, length(hex(encode({data}))) // 2 + 1),
        lambda i: ('0x' || substr(hex(encode({data})), 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"""


@register(
    "op13_spelling",
    rf"""
    WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS t(i)
        UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM bits WHERE k < 8),
    crcs AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
    drawn AS (SELECT run, n, {_crc_sql("id || ':' || run", "crc")} AS h FROM counted, crcs),
    lost AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER)
        || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM drawn),
    vocab AS (SELECT word, sum(n)::BIGINT AS n FROM lost GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
    shorter AS (SELECT word, n, i, left(word, (i - 1)::INTEGER) || substr(word, (i + 1)::INTEGER) AS rest
        FROM vocab, unnest(range(1, length(word) + 1)) AS t(i)),
    pairs AS (
        SELECT a.word AS word, b.word AS near FROM shorter a JOIN shorter b USING (i, rest)
        WHERE a.word <> b.word AND length(a.word) = length(b.word)
        UNION SELECT s.word, v.word FROM shorter s JOIN vocab v ON s.rest = v.word
        UNION SELECT v.word, s.word FROM shorter s JOIN vocab v ON s.rest = v.word),
    best AS (SELECT p.word, count(*) AS n_near, max(b.n) AS m FROM pairs p JOIN vocab b ON p.near = b.word GROUP BY p.word),
    named AS (SELECT t.word, any_value(t.n_near) AS n_near, any_value(t.m) AS m, min(p.near) AS near FROM best t
        JOIN pairs p USING (word) JOIN vocab b ON p.near = b.word AND b.n = t.m GROUP BY t.word),
    forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form,
        CASE WHEN m >= 2 * n THEN m END AS form_n FROM vocab v LEFT JOIN named USING (word)),
    chain AS (SELECT word, word AS root, 0 AS k FROM forms
        UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
    """,
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.word_counts(table(spark, sf_dir, "documents"))
    return variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
