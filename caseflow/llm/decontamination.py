"""Benchmark decontamination: word windows of a test set looked up in training texts.

The distinct windows of the benchmark, as normalised strings keyed by a hash, form a
broadcast hash set. Every training text is scanned once: the hash of each of its windows
probes the set, and a hit is verified word by word in the same join. Only hits, and one
row per text, are shuffled.

The set is broadcast in slices of at most `BROADCAST_GRAMS` windows, which are counted;
an ordinary benchmark is one slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import lower_ascii, require, unused

#: What stands between words: ASCII but letters and digits (after lower-casing).
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_GRAMS = 1_000_000
#: Stands for "the text itself" among the window hashes of a text.
_SELF = ""


def words_of(text: Column) -> Column:
    """The normalised words; no words if the text is NULL."""
    words = F.array_remove(F.split(lower_ascii(text), BREAKS), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def _window_at(words: Column, start: Column, size: Column | int) -> Column:
    return F.slice(words, start, size)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Columns (item, n, gram): each item's windows, as words joined by blanks.

    An item with fewer than `size` words, but not none, is one window. Rows of a NULL
    item_id are windows of one item without a name.
    """
    words = require(benchmark, "item_id", "text").select(
        F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")
    )
    n = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    return (
        words.filter(F.size("words") > 0)
        .select("item", n.alias("n"), "words", F.explode(starts).alias("at"))
        .select("item", "n", F.array_join(_window_at(F.col("words"), F.col("at"), F.col("n")), " ").alias("gram"))
        .distinct()
    )


def _gram_hash(words: Column) -> Column:
    return F.xxhash64(words)


def _window_hashes(words: Column, many: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), many)
    hashed = F.transform(starts, lambda i: _gram_hash(_window_at(words, i, size)))
    return F.when(many > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _scan(texts: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Hits (the columns of `texts` but words, at, n, gram) and one row per text with n 0."""
    probes = [F.array(_gram_hash(F.array(F.lit(_SELF))))]
    counts = [F.lit(1)]
    for size in sizes:
        many = F.greatest(F.size("words") - size + 1, F.lit(0))
        probes.append(_window_hashes(F.col("words"), many, size))
        counts.append(many)
    # The place in the joined list tells the window's size and its first word.
    at, n, done = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for size, many in zip([0, *sizes], counts):
        inside = (F.col("_place") >= done) & (F.col("_place") < done + many)
        at = F.when(inside, F.col("_place") - done).otherwise(at)
        n = F.when(inside, F.lit(size)).otherwise(n)
        done = done + many
    probed = texts.select("*", F.posexplode(F.concat(*probes)).alias("_place", "_hash"))
    probed = probed.withColumns({"at": at, "n": n})
    same = (F.col("_hash") == F.col("_gram_hash")) & (F.col("n") == F.col("_gram_n"))
    verified = (F.col("n") == 0) | (F.array_join(_window_at(F.col("words"), F.col("at") + 1, F.col("n")), " ") == F.col("gram"))
    kept = [c for c in texts.columns if c != "words"]
    return probed.join(F.broadcast(grams), same & verified).select(*kept, "at", "n", "gram")


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_hash, copies, n_words, spans
    (array of (at, n), in order) and grams (the windows that occur).

    Repeated rows are counted in `copies`; rows with one doc_id and several texts stay
    apart. NULL and empty texts have no words. An empty benchmark hits nothing.
    """
    windows = benchmark_windows(benchmark, size)
    distinct = windows.select("n", "gram").distinct()
    counted = distinct.groupBy("n").count().collect()  # at most `size` rows
    sizes = sorted(r["n"] for r in counted)
    slices = -(-sum(r["count"] for r in counted) // BROADCAST_GRAMS)
    texts = require(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    texts = texts.withColumn("n_words", F.size("words").cast("bigint"))
    grams = distinct.select(
        F.col("n").alias("_gram_n"), "gram", _gram_hash(F.split("gram", " ")).alias("_gram_hash")
    )
    itself = docs.sparkSession.range(1).select(
        F.lit(0).alias("_gram_n"), F.lit(None).cast("string").alias("gram"),
        _gram_hash(F.array(F.lit(_SELF))).alias("_gram_hash"),
    )
    parts = []
    for i in range(max(slices, 1)):
        part = grams if slices <= 1 else grams.filter(F.pmod("_gram_hash", F.lit(slices)) == i)
        parts.append(_scan(texts, part.union(itself) if i == 0 else part, sizes))
    hits = reduce(DataFrame.union, parts)
    is_hit = F.col("n") > 0
    return hits.groupBy("doc_id", "text_hash").agg(
        F.count_if(~is_hit).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(is_hit, F.struct("at", "n")))).alias("spans"),
        F.collect_set("gram").alias("grams"),
    )


def covered(spans: Column) -> Column:
    """Number of words inside spans (sorted array of (at, n)); overlaps count once."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("end"))

    def add(so_far: Column, span: Column) -> Column:
        stop = (span["at"] + span["n"]).cast("bigint")
        fresh = F.greatest(stop - F.greatest(so_far["end"], span["at"].cast("bigint")), F.lit(0).cast("bigint"))
        return F.struct((so_far["total"] + fresh).alias("total"), F.greatest(so_far["end"], stop).alias("end"))

    return F.aggregate(spans, start, add, lambda s: s["total"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit (words inside a window that
    occurs), n_items, item_ids (sorted) and contaminated. See `find_hits` for edge cases.
    """
    hits = find_hits(docs, benchmark, size)
    items = benchmark_windows(benchmark, size).select("item", "gram").filter(F.col("item").isNotNull())
    found = (
        hits.select("doc_id", "text_hash", "copies", "n_words", covered(F.col("spans")).alias("n_hit"),
                    F.explode_outer("grams").alias("gram"))
        .join(items, "gram", "left")
        .groupBy("doc_id", "text_hash", "copies", "n_words", "n_hit")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        "item_ids",
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, remove: str = "documents"
) -> DataFrame:
    """`docs` without its contaminated documents, or without the hit words.

    With `remove="spans"` a hit word goes with the characters up to the next word.
    All columns, repeated rows and rows without doc_id or text stay as they are; a row is
    judged by its own text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    hits = find_hits(docs, benchmark, size).filter(F.size("spans") > 0)
    of, text, spans = unused(docs, "_id", "_hash", "_spans")
    keys = hits.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text), F.col("spans").alias(spans))
    same = docs["doc_id"].eqNullSafe(keys[of]) & (F.xxhash64(docs["text"]) == keys[text])
    if remove == "documents":
        return docs.join(keys, same, "left_anti")
    joined = docs.join(keys, same, "left")
    cut = F.when(F.col(spans).isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col(spans)))
    return joined.withColumn("text", cut).select(*docs.columns)


def without_spans(text: Column, spans: Column) -> Column:
    """`text` without the words in `spans` and what follows each of them."""
    letters = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = F.array_remove(F.split(text, gaps), "")
    between = F.split(text, letters)
    inside = F.array_distinct(
        F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    )
    hit = F.map_from_arrays(inside, F.transform(inside, lambda _: F.lit(True)))
    pieces = F.transform(
        words,
        lambda w, i: F.when(F.element_at(hit, i).isNotNull(), F.lit("")).otherwise(
            F.concat(w, F.element_at(between, i + 2))
        ),
    )
    return F.concat(F.element_at(between, 1), F.array_join(pieces, ""))
