"""Spelling variants: words one edit apart, by scans of sorted word lists.

A scan goes through a sorted list and keeps, for each prefix of the word it stands at, the
row of the edit matrix against the query, of which one edit needs a band of three cells.
The next word shares a prefix with this one, whose rows are reused; if a row has no cell of
one edit or less, all words that share its prefix are skipped at once.

Words one edit apart share the half before the edit or the half behind it. So there are two
lists, of the words and of the words read backwards, and a query is scanned only from its
own place to the end of the words that share its first half; of the pair, the first word in
the order of the list is the query. Lists are sorted by Spark in ranges and cut into blocks.
A query goes to its own block and to those later ones whose words all start with something
within one edit of its start: the same scan over the prefixes that blocks share. Queries of
a block are split into groups of a bounded size, so that a common prefix makes more groups
and no larger ones.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import discard, lower_ascii, require, stage, write_staged

LETTERS = "A-Za-zÀ-ÿ"
#: Words shorter or rarer than this are not grouped.
MIN_LENGTH = 5
MIN_COUNT = 3
#: One occurrence in so many loses a letter.
DAMAGED = 97
#: A form is at least so many times as common as the word.
RATIO = 2
#: Words and characters of a block, at least and at most.
BLOCK = 8_192
BLOCK_CHARS = 1 << 20
#: Blocks, about, beyond which they get larger: so many places are broadcast at most, and
#: one more for each partition and each `BLOCK_CHARS` characters.
MAX_BLOCKS = 16_384
#: Characters by which the places of blocks are told apart.
PLACE_CHARS = 64
#: Queries from other blocks that one group gets, about.
QUERIES = 32_768

_PAIRS = "word string, n bigint, near string, near_n bigint"
#: Rows of the edit matrix: cells (i, i - 1), (i, i), (i, i + 1). Before the first letter, and
#: behind letters that are alike.
_START, _ALIKE = (2, 0, 1), (1, 0, 1)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Columns word, n (occurrences) of the words of `docs` (doc_id, text).

    Words are runs of letters, A-Z lower-cased. An occurrence whose CRC-32 of
    `<doc_id>:<run>` is a multiple of `DAMAGED` lacks the letter at that CRC modulo its
    length. A missing doc_id counts as an empty text; a missing text has no words.
    """
    rows = require(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), lower_ascii(F.col("text")).alias("text")
    )
    # Shorter runs cannot make a word, so the pattern passes them over.
    pattern = F.lit(f"[{LETTERS}]{{{min_length},}}")
    runs = rows.select("doc", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    long = words.filter(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class SortedList:
    """Texts, the prefix each shares with the one before (`lcp`), and the next place that
    shares less with its predecessor (`jump`)."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lcp = [0, *(shared_prefix(a, b) for a, b in pairwise(texts))]
        self.jump = [len(texts)] * len(texts)
        open_places: list[int] = []
        for i in range(len(texts) - 1, -1, -1):
            while open_places and self.lcp[open_places[-1]] >= self.lcp[i]:
                open_places.pop()
            if open_places:
                self.jump[i] = open_places[-1]
            open_places.append(i)

    def scan(self, query: str, i: int, end: int, have: int, least: int, whole: bool) -> list[int]:
        """Places from `i` to before `end` of texts one edit from `query` (`whole`), or that
        start with something within one edit of a start of it.

        Text `i` shares `have` letters with the query. The scan ends at the first text that
        shares fewer than `least` with it.
        """
        texts, lcp, jump = self.texts, self.lcp, self.jump
        size, found = len(query), []
        padded = f"\0{query}\0\0\0"
        # rows[d] is the row of the first d letters of the text scanned last.
        rows = [_START, *[_ALIKE] * (size + 3)]
        while i < end and have >= least:
            text, d = texts[i], have
            low, mid, high = rows[d]
            length, hopeless = len(text), False
            while d < length:
                letter = text[d]
                new_low = low if letter == padded[d] else low + 1
                if mid + 1 < new_low:
                    new_low = mid + 1
                if letter != padded[d + 1]:
                    mid += 1
                if new_low + 1 < mid:
                    mid = new_low + 1
                if high + 1 < mid:
                    mid = high + 1
                if letter != padded[d + 2]:
                    high += 1
                if mid + 1 < high:
                    high = mid + 1
                low = new_low
                d += 1
                if low > 1 and mid > 1 and high > 1:
                    hopeless = True
                    break
                rows[d] = (low, mid, high)
            i += 1
            if hopeless:
                while i < end and lcp[i] >= d:
                    i = jump[i]
            elif not whole or -1 <= size - length <= 1 and (mid, high, low)[size - length] == 1:
                found.append(i - 1)
            if i < end:
                have = min(lcp[i], d)
        return found


def cut_into_blocks(size: int):
    """Number the blocks of a sorted partition, each of `size` rows or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, chars = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks = []
            for key in batch.column("key").to_pylist():
                if rows >= size or rows and chars + len(key) > BLOCK_CHARS:
                    block, rows, chars = block + 1, 0, 0
                rows, chars = rows + 1, chars + len(key)
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], ["key", "n", "block"])

    return run


def half(size: int, backwards: bool) -> int:
    """Letters that a word shares, from the start of the list's spelling, with the words it
    is compared to: before the edit in the one list, behind it in the other."""
    return (size + 1) // 2 if backwards else size // 2


def later_blocks(places: list[tuple], backwards: bool):
    """Over rows (key, n, block): the later blocks that each key has to be compared to.

    `places`: block, first and last key, cut to `PLACE_CHARS` letters, in order.
    """
    blocks, firsts = [p[0] for p in places], [p[1] for p in places]
    shared = SortedList([p[1][: shared_prefix(p[1], p[2])] for p in places])
    at = {block: i for i, block in enumerate(blocks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, own = (batch.column(c).to_pylist() for c in ("key", "n", "block"))
            out: list[tuple] = []
            for key, n, block in zip(keys, counts, own):
                start = at[block] + 1
                end = bisect_right(firsts, key[: half(len(key), backwards)][:PLACE_CHARS] + chr(0x10FFFF))
                if start < end:
                    out += [(key, n, blocks[i]) for i in shared.scan(key, start, end, 0, 0, False)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], ["key", "n", "block"]
                )

    return run


def compare(backwards: bool):
    """The pairs one edit apart of a block's words and of queries from other blocks."""

    def run(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        members = members.sort_by("key")
        listed, counts = SortedList(members["key"].to_pylist()), members["n"].to_pylist()
        texts, lcp, end = listed.texts, listed.lcp, len(listed.texts)
        out: list[tuple] = []

        def report(word: str, n: int, found: list[int]) -> None:
            for i in found:
                near = texts[i]
                a, b = (word[::-1], near[::-1]) if backwards else (word, near)
                # Each pair is reported from one list: the one in which it shares half.
                if (shared_prefix(a, b) < max(len(a), len(b)) // 2) == backwards:
                    out.extend([(a, n, b, counts[i]), (b, counts[i], a, n)])

        if key[1].as_py() == 0:
            for i, word in enumerate(texts[:-1]):
                least = half(len(word), backwards)
                if lcp[i + 1] >= least:
                    report(word, counts[i], listed.scan(word, i + 1, end, lcp[i + 1], least, True))
        for word, n in zip(queries["key"].to_pylist(), queries["n"].to_pylist()):
            report(word, n, listed.scan(word, 0, end, shared_prefix(word, texts[0]), half(len(word), backwards), True))
        columns = zip(*out) if out else ([], [], [], [])
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "n", "near", "near_n"])

    return run


def near_in_list(words: DataFrame, size: int, backwards: bool, queries: int = QUERIES) -> DataFrame:
    """The pairs of one list, both ways round: word, n, near, near_n."""
    spark = words.sparkSession
    key = F.reverse("word") if backwards else F.col("word")
    ordered = words.select(key.alias("key"), "n").repartitionByRange("key").sortWithinPartitions("key")
    rows = stage(ordered.mapInArrow(cut_into_blocks(size), "key string, n bigint, block bigint"))
    start = F.substring("key", 1, PLACE_CHARS)
    places = rows.groupBy("block").agg(F.min(start).alias("first"), F.max(start).alias("last")).orderBy("block").collect()
    sent = stage(rows.mapInArrow(later_blocks([tuple(p) for p in places], backwards), rows.schema))
    # One row per block that gets queries: as few as the places above.
    fans = sent.groupBy("block").agg(F.ceil(F.count("*") / queries).cast("int").alias("fan"))
    fans = F.broadcast(spark.createDataFrame(fans.collect(), "block bigint, fan int"))
    salt = F.pmod(F.xxhash64("key"), F.col("fan")).cast("int")
    asked = sent.join(fans, "block").select("block", salt.alias("salt"), "key", "n")
    salts = F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)
    members = rows.join(fans, "block", "left").select("block", F.explode(salts).alias("salt"), "key", "n")
    return members.groupBy("block", "salt").cogroup(asked.groupBy("block", "salt")).applyInArrow(compare(backwards), _PAIRS)


def near_words(words: DataFrame, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """All pairs of different words one inserted, deleted or replaced letter apart, both ways
    round: word, n, near, near_n. `words`: word (each once, not NULL), n."""
    words = stage(words.select("word", F.col("n").cast("bigint").alias("n")))
    size = max(block, -(-words.count() // MAX_BLOCKS))
    return near_in_list(words, size, False, queries).union(near_in_list(words, size, True, queries))


def roots(forms: DataFrame) -> DataFrame:
    """Columns word, root: where the forms of `forms` (word, form) lead. Forms get ever more
    common, so there are no rings; each round doubles the steps, until none is left."""
    spark = forms.sparkSession
    path = write_staged(forms.select("word", F.col("form").alias("root")))
    while True:
        now = spark.read.schema("word string, root string").parquet(path)
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        following = write_staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        discard(spark, path)
        path = following


def variant_forms(words: DataFrame, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """One row per word of `words` (word, n): word, form, root, n, n_near, form_n.

    n_near counts the words one edit away; the most common of them (of several, the first
    in the order of code points) is the `form` if it is at least `RATIO` times as common as
    the word. `root` is the last of the forms of forms; the word itself if it has none.
    """
    words = stage(words)
    none = F.lit(None)
    alone = words.select("word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n"))
    both = alone.union(near_words(words, block, queries))
    first = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rarer"), "near")))
    found = both.groupBy("word", "n").agg(F.count("near").alias("n_near"), first.alias("first"))
    common = -F.col("first.rarer") >= RATIO * F.col("n")
    found = stage(
        found.select(
            "word", "n", "n_near", F.when(common, F.col("first.near")).alias("form"), F.when(common, -F.col("first.rarer")).alias("form_n")
        )
    )
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
