"""The queries of the corpus operators, with SQL where SQL can express them.

Each applies its operator, with the parameters below, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (
    decontamination,
    exact_dedup,
    hard_negatives,
    html_text,
    line_dedup,
    nn_descent,
    packing,
    pii,
    simhash,
    spelling,
    toxicity,
    url_filter,
    warc,
)
from caseflow.llm.common import table

#: 4-word shingles; fingerprints that differ in at most 4 bits are near duplicates.
SHINGLE, DISTANCE = 4, 4


def tokenizer_path() -> str:
    """Byte-pair ranks of the vocabulary that `byte_bpe_50k.json` holds too; the ids are
    the same and come several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = line_dedup.line_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "line_no", "n_chars", "n_links", "class_doc_id", "class_line_no", "kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def _hex(text: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, size), 16, 10).cast("int")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: the tables have no fetch times, so the id makes one."""
    seconds = (F.col("page_id") * 7919) % 126_230_400
    at = F.timestamp_add("SECOND", seconds, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries for a quarter of the domains, hosts and first folders of the pages:
    three of them each, with dates and statuses that a hash of the value makes."""
    urls = table(spark, sf_dir, "pages").select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    folder = F.regexp_extract("path", "^(/[^/]+/)", 1)
    values = F.array(
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("value")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")),
        F.struct(F.lit("prefix").alias("kind"), F.when(folder != "", F.concat("host", folder)).otherwise("").alias("value")),
    )
    known = urls.filter("host is not null").select(F.explode(values).alias("v")).select("v.*").filter("value <> ''").distinct()
    name = F.concat("kind", F.lit(":"), "value")
    listed = known.filter(_hex(name, 1, 1) < 4)
    dated = listed.select("kind", "value", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    seed = F.concat(name, F.lit(":"), F.col("i").cast("string"))
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    status = _hex(seed, 5, 1)
    return dated.select(
        F.lit("house").alias("list"), "kind", "value",
        F.timestamp_add("DAY", _hex(seed, 1, 4) % 1461, start).alias("listed_at"),
        F.when(status < 6, "block").when(status < 10, "allow").otherwise("off").alias("status"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_captures(captures(spark, sf_dir), list_entries(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(spark, warc.write_archive(table(spark, sf_dir, "pages")))
    return warc.reconstruct(records).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans")
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), SHINGLE, DISTANCE)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination.contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    items = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return report.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).drop("n_chars")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(spelling.vocabulary(table(spark, sf_dir, "documents")))


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
probes AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM grams)
    )
),
hits AS (SELECT p.doc_id, p.n, p.i, g.item FROM probes p JOIN grams g ON p.n = g.n AND p.gram = g.gram),
words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
),
found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP5_SQL = r"""
WITH pieces AS (
    SELECT page_id, url, TIMESTAMP '2020-01-01' + to_seconds((page_id * 7919) % 126230400) AS fetched_at,
        rtrim(lower(regexp_replace(regexp_replace(
            regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '.') AS host,
        regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1) AS path
    FROM pages
),
caps AS (
    SELECT row_number() OVER () AS cap, page_id, url, fetched_at,
        CASE WHEN host <> '' AND length(host) <= 253 THEN host END AS host,
        CASE WHEN path = '' THEN '/' ELSE path END AS path
    FROM pieces
),
known AS (
    SELECT DISTINCT kind, value FROM (
        SELECT 'domain' AS kind, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS value FROM caps
        UNION ALL SELECT 'host', host FROM caps
        UNION ALL SELECT 'prefix', host || regexp_extract(path, '^(/[^/]+/)', 1) FROM caps
            WHERE regexp_extract(path, '^(/[^/]+/)', 1) <> ''
    ) WHERE value <> ''
),
entries AS (
    SELECT kind, value,
        TIMESTAMP '2020-01-01' + to_days(CAST('0x' || substr(md5(kind || ':' || value || ':' || i), 1, 4) AS INTEGER) % 1461) AS t,
        CAST('0x' || substr(md5(kind || ':' || value || ':' || i), 5, 1) AS INTEGER) AS s
    FROM known, range(3) r(i) WHERE CAST('0x' || substr(md5(kind || ':' || value), 1, 1) AS INTEGER) < 4
),
latest AS (
    SELECT kind, value, t, max(CASE WHEN s < 6 THEN 2 WHEN s < 10 THEN 1 ELSE 0 END) AS s
    FROM entries GROUP BY kind, value, t
),
spans AS (SELECT *, lead(t) OVER (PARTITION BY kind, value ORDER BY t) AS until FROM latest),
matched AS (
    SELECT c.cap, e.*, length(e.value) AS size, CASE e.kind WHEN 'domain' THEN 1 WHEN 'host' THEN 2 ELSE 3 END AS k
    FROM caps c JOIN spans e ON e.s > 0 AND c.fetched_at >= e.t AND (e.until IS NULL OR c.fetched_at < e.until)
    AND CASE e.kind WHEN 'host' THEN c.host = e.value
        WHEN 'domain' THEN c.host = e.value OR ends_with(c.host, '.' || e.value)
        ELSE starts_with(c.host || c.path, e.value) END
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY cap ORDER BY size DESC, k DESC, s DESC, value) AS place,
        count(*) OVER (PARTITION BY cap) AS n FROM matched
)
SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(r.n, 0) AS n_active,
    CASE r.s WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'unlisted' END AS verdict,
    CASE WHEN r.n > 0 THEN 'house' END AS list, r.kind, r.value, r.t AS valid_from
FROM caps c LEFT JOIN ranked r ON c.cap = r.cap AND r.place = 1
"""

OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
        octet_length(encode(coalesce(html, ''))) AS bytes FROM pages
),
first AS (SELECT digest, min(page_id) AS head FROM p WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
    CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN first ON p.digest = first.digest
"""

OP11_SQL = r"""
WITH bare AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM bare WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""

OP12_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_nn_descent": op4_nn_descent,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op5_url_filter": OP5_SQL, "op6_warc": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL}
