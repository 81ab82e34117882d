"""Personal data: patterns, and terms that reveal what the patterns find.

Patterns find the protected entities (mail and IP addresses, card and phone numbers).
Following the information-theoretic view of sanitisation, a term reveals an entity as far
as their pointwise mutual information over the corpus, log2(N n(c,t) / (n(c) n(t))),
covers the information of the entity itself, log2(N / n(c)). Here N counts the different
texts, n(c) those with the entity, n(t) those with the term, and n(c,t) those with the
term within `REACH` characters of the entity. A term that reveals at least `DISCLOSURE` of
an entity, in `SUPPORT` texts or more, is disclosing wherever it occurs: it is generalised
to a label if it reveals several entities of one kind, else removed.

Everything is DataFrame functions. Texts do not move: counts and short lists do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import let, require, stage
from caseflow.operators.skew import broadcast_if_small

REACH = 80
DISCLOSURE = 0.8
SUPPORT = 2
MIN_TERM = 3
#: Rows of lists that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 500_000
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The base patterns. Quantifiers are possessive and a match starts where its first run of
#: characters does (or the match before it ends), which finds the same matches without
#: trying each run from each of its characters.
_STARTS = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _STARTS.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _STARTS.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
WORD = r"[\p{L}\p{N}]++"
GAP = r"[^\p{L}\p{N}]++"
_CHUNK = 256
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def running_sum(values: Column) -> Column:
    """For each element (long) the sum of those before it. Chunks keep long arrays from
    being copied for every element."""
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("before"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["total"] + x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before"))

    def summed(values: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")),
            lambda c: F.aggregate(F.slice(values, c * _CHUNK + 1, _CHUNK), start, add),
        )
        return F.when(F.size(values) > 0, let(pieces, shifted)).otherwise(empty)

    def shifted(pieces: Column) -> Column:
        firsts = F.aggregate(F.transform(pieces, lambda c: c["total"]), start, add)["before"]
        return F.flatten(F.zip_with(pieces, firsts, lambda c, first: F.transform(c["before"], lambda b: b + first)))

    return let(values, summed)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches, in code points, end exclusive."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern), 1, F.size(found))  # what stands before each match
        steps = F.zip_with(
            between, found, lambda b, m: F.struct(F.char_length(b).cast("bigint").alias("b"), F.char_length(m).cast("bigint").alias("m"), m.alias("value"))
        )
        return let(steps, spans)

    def spans(steps: Column) -> Column:
        before = running_sum(F.transform(steps, lambda s: s["b"] + s["m"]))
        return F.zip_with(before, steps, lambda at, s: F.struct((at + s["b"]).alias("start"), (at + s["b"] + s["m"]).alias("end"), s["value"].alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's test."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _part_fits(part: Column) -> Column:
    plain = F.ltrim(part, F.lit("0"))
    return (F.char_length(plain) < 3) | ((F.char_length(plain) == 3) & (plain <= "255"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _part_fits)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of a kind; none in a NULL text."""
    tried = F.rlike(text, F.lit(_NEEDS[kind]))
    kept = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    none = F.array().cast(_SPAN)
    return F.when(tried, kept).otherwise(none)


def _with_base(docs: DataFrame) -> DataFrame:
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    return rows.withColumns({f"_{k}": base_spans(F.col("_text"), k) for k in KINDS})


def _entity(kind: str, value: Column) -> Column:
    """One spelling of an entity."""
    return F.lower(value) if kind in ("email", "ip") else _digits(value)


def _terms(text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(text), GAP))
    return F.filter(words, lambda w: F.char_length(w) >= MIN_TERM)


def _contexts(docs: DataFrame) -> DataFrame:
    """A row per entity and text: text_hash, kind, entity, terms near it."""
    spans = F.concat(*[_tagged(F.col(f"_{k}"), k) for k in KINDS])
    found = _with_base(docs).select("text_hash", "_text", F.explode(spans).alias("m"))
    # The words cut by the reach are left out.
    first = F.greatest(F.col("m.start") - REACH, F.lit(0))
    left = F.col("_text").substr((first + 1).cast("int"), (F.col("m.start") - first).cast("int"))
    left = F.when(first > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.col("_text").substr((F.col("m.end") + 1).cast("int"), F.lit(REACH))
    cut = F.char_length("_text") > F.col("m.end") + REACH
    right = F.when(cut, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    return found.select("text_hash", "m.kind", "m.entity", _terms(F.concat(left, F.lit(" "), right)).alias("terms"))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), _entity(kind, m["value"]).alias("entity")),
    )


def _different_texts(docs: DataFrame) -> DataFrame:
    """One row per text: doc_id, text_hash, text. Repeated texts are known by a count; of
    those the rows of the smallest doc_id, which may be several, are brought together."""
    counted = docs.groupBy("text_hash").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("_first"))
    again = broadcast_if_small(counted.filter("n > 1").select(F.col("text_hash").alias("_hash"), "_first"), BROADCAST_ROWS)
    joined = docs.join(again, F.col("text_hash") == F.col("_hash"), "left")
    first = joined.filter(F.col("_first") == F.coalesce("doc_id", F.lit(-1))).dropDuplicates(["text_hash"])
    return joined.filter("_first is null").union(first).select("doc_id", "text_hash", "text")


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Columns term, kind, entities (how many it reveals), label (NULL: remove)."""
    rows = _keyed(docs)
    texts = _different_texts(rows)
    contexts = stage(_contexts(texts))
    entities = contexts.groupBy("kind", "entity").agg(F.countDistinct("text_hash").alias("n_c"))
    near = contexts.select("text_hash", "kind", "entity", F.explode("terms").alias("term")).distinct()
    pairs = near.groupBy("kind", "entity", "term").agg(F.count("*").alias("n_ct")).filter(F.col("n_ct") >= support)
    pairs = stage(pairs.join(entities, ["kind", "entity"]))
    wanted = broadcast_if_small(pairs.select("term").distinct(), BROADCAST_ROWS)
    used = texts.select(F.explode(_terms(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    counts = used.groupBy("term").agg(F.count("*").alias("n_t"))
    total = rows.select("text_hash").distinct().count()
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_c"))
    mutual = F.log2(F.lit(float(max(total, 1))) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    revealed = pairs.join(counts, "term").filter((information > 0) & (mutual >= disclosure * information))
    by_term = revealed.groupBy("term").agg(
        F.count("*").alias("entities"), F.min("kind").alias("kind"), F.countDistinct("kind").alias("kinds")
    )
    general = F.when((F.col("entities") > 1) & (F.col("kinds") == 1), F.concat(F.lit("["), F.upper("kind"), F.lit(" TERM]")))
    return by_term.select("term", "kind", "entities", general.alias("label"))


def _keyed(docs: DataFrame) -> DataFrame:
    rows = require(docs, "doc_id", "text")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per row of `docs`: doc_id, text, spans (array of kind, start, end, label; the
    base kinds in the order of `KINDS`, then terms; by start).

    The base patterns match leftmost and without overlap within a kind; matches that fail
    the kind's test are dropped. NULL and empty texts have no spans. A term's label is what
    takes its place, "" if it is removed. Repeated rows have equal spans; a NULL doc_id is
    carried along.
    """
    rows = _keyed(docs)
    terms = stage(disclosing_terms(docs, disclosure, support))
    small = broadcast_if_small(terms.select("term", "label"), BROADCAST_ROWS)
    held = rows.select("text_hash", F.explode(_terms(F.col("text"))).alias("term")).join(small, "term")
    listed = held.groupBy("text_hash").agg(
        F.collect_set(F.struct("term", F.coalesce("label", F.lit("")).alias("label"))).alias("_held")
    )
    listed = stage(listed.withColumnRenamed("text_hash", "_hash"))
    joined = rows.join(broadcast_if_small(listed, BROADCAST_ROWS), F.col("text_hash") == F.col("_hash"), "left")
    labels = F.map_from_entries("_held")
    words = F.filter(matches(F.lower(F.col("_text")), WORD), lambda m: F.map_contains_key(F.col("_labels"), m["value"]))
    out = _with_base(joined).withColumn("_labels", F.when(F.col("_held").isNotNull(), labels))
    # Lower-casing that changes the length would move the places; such texts are read as they are.
    same_length = F.char_length(F.lower("_text")) == F.char_length("_text")
    plain = F.filter(matches(F.col("_text"), WORD), lambda m: F.map_contains_key(F.col("_labels"), F.lower(m["value"])))
    out = out.withColumn(
        "_term",
        F.when(F.col("_labels").isNull(), F.array().cast(_SPAN)).when(same_length, words).otherwise(plain),
    )

    def named(kind: str) -> Column:
        label = lambda m: F.lit(f"[{kind.upper()}]")
        if kind == TERM:
            label = lambda m: F.element_at(F.col("_labels"), F.lower(m["value"]))
        return F.transform(
            F.col(f"_{kind}"),
            lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), label(m).alias("label")),
        )

    return out.select("doc_id", "text", F.concat(*[named(k) for k in (*KINDS, TERM)]).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def sanitised(found: DataFrame) -> DataFrame:
    """The rows of `find_personal_data` with their spans replaced by labels in `text`.

    Of overlapping spans the first by start, and then the longest, is replaced; what
    another has beyond it goes too.
    """
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["label"].alias("label"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def add(so_far: Column, span: Column) -> Column:
        gap = F.greatest(span["start"] - so_far["at"], F.lit(0)).cast("int")
        between = F.col("text").substr((so_far["at"] + 1).cast("int"), gap)
        label = F.when(span["start"] >= so_far["at"], span["label"]).otherwise(F.lit(""))
        return F.struct(F.concat(so_far["out"], between, label).alias("out"), F.greatest(so_far["at"], -span["end"]).alias("at"))

    rest = F.aggregate(by_place, start, add, lambda s: F.concat(s["out"], F.col("text").substr((s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.withColumn("text", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")))
