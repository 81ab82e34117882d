"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, of toxic and of ordinary labelled documents, give each letter of a word its
probability after the `ORDER - 1` letters before it. Both back off, with absolute
discounting, to one shared Kneser-Ney model whose continuation counts come from every
document, labelled or not; so an expression that neither class has seen weighs nothing.
A document is measured by the difference of its two log-likelihoods over its length: once
plainly, and once for each of `EXCESS` with what its words have beyond that much, since a
few words make a text toxic and the noise of many others would hide them. A logistic curve
through the labelled documents makes these a score. Each of those documents is measured
with models that have not seen it (two halves, crosswise).

What scoring needs of the models is one number per gram of a labelled document, and one
per context for grams it has not seen. That table is broadcast. It is bounded by
`max_labelled`, the number of labelled documents used (a sample by hash if there are
more); shared counts are not sampled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import discard, require, stage, unused, write_staged

ORDER = 6
DISCOUNT = 0.75
MAX_LABELLED = 200_000
#: Every fifth document, by CRC-32 of its id, is held out of training.
FOLDS = 5
#: Different words counted or scored before a task empties its table.
WORDS_HELD = 500_000
WORDS_AT_ONCE = 20_000
WORDS_SCORED = 200_000
#: Grams in a batch of counts.
ROWS_SENT = 50_000
CHUNK = 1 << 20
MAX_WORD = 256
SEED = 42
#: A word's log ratio counts beyond these.
EXCESS = (0.0, 2.0, 4.0, 6.0, 8.0)
START, END = "\x02", "\x03"
#: Sides: ordinary and toxic documents of either half.
SIDES = ("o1", "o2", "t1", "t2")
_GAP = re.compile(r"\s")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _word_sets(text: str) -> Iterator[set[str]]:
    """The different lower-case words of a text, a bounded part of it at a time. Words of more
    than `MAX_WORD` letters are cut."""
    start = 0
    while start < len(text):
        near = start + CHUNK
        gap = _GAP.search(text, near, near + MAX_WORD)
        end = gap.start() if gap else min(near + MAX_WORD, len(text))
        words = set(text[start:end].lower().split())
        if words and max(map(len, words)) > MAX_WORD:
            words = {w[i : i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)}
        yield words
        start = end


@lru_cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the `size` letters from each place on."""
    factors = _multipliers(size + 1)
    total = np.full(len(at), factors[size])
    for i in range(size):
        total += factors[i] * codes[at + i]
    return total ^ (total >> np.uint64(29))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_places(words: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The padded words in one string, where its grams begin, and the word of each."""
    padded = "".join([START * (order - 1) + w + END for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + order
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(np.arange(len(padded)) <= ends[of] - order)
    return padded, at, of[at]


def _some(words: list[str]) -> Iterator[list[str]]:
    """The words in lists of a bounded number of letters."""
    for start in range(0, len(words), WORDS_AT_ONCE):
        yield words[start : start + WORDS_AT_ONCE]


def training_labels(labels: DataFrame, max_labelled: int) -> DataFrame:
    """Columns doc_id, side: labelled documents outside the held-out fold, at most
    `max_labelled` of them, by hash. Documents with unlike labels are left out."""
    rows = require(labels, "doc_id", "toxic").filter("toxic is not null and doc_id is not null")
    agreed = rows.groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    part = fold(F.col("doc_id"))
    side = F.concat(F.when(F.col("hi") > 0, "t").otherwise("o"), F.when(part <= FOLDS // 2, "1").otherwise("2"))
    return (
        agreed.filter((F.col("lo") == F.col("hi")) & (part != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .select("doc_id", side.alias("side"))
    )


def _with_side(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    # At most `max_labelled` rows.
    return docs.join(F.broadcast(chosen), "doc_id", "left")


def _gram_batches(sides: dict[str | None, Counter], order: int) -> Iterator[pa.RecordBatch]:
    """The grams of the words counted on each side, which are emptied."""
    words = list(set().union(*sides.values()))
    place = dict(zip(words, range(len(words))))
    table = np.zeros((len(words), 1 + len(SIDES)))
    for i, counter in enumerate(sides.values()):
        table[list(map(place.__getitem__, counter)), i] = list(counter.values())
        counter.clear()
    del place
    table[:, 0] = table.sum(axis=1)
    # Grams are numbers until each is there once: only then is it cut out of its words.
    padded: list[str] = []
    parts: list[tuple] = []
    done = 0
    for some in _some(words):
        text, at, of = _gram_places(some, order)
        keys, first, group = np.unique(_hash(_letters(text), at, order), return_index=True, return_inverse=True)
        weights = table[done : done + len(some)][of]
        sums = np.column_stack([np.bincount(group, w, len(keys)).astype(np.int32) for w in weights.T])
        parts.append((keys, at[first].astype(np.int32), np.full(len(keys), len(padded), np.int32), sums))
        padded.append(text)
        done += len(some)
    if not parts:
        return
    del words, table
    every, at, of, sums = (np.concatenate(p) for p in zip(*parts))
    parts.clear()
    _, first, group = np.unique(every, return_index=True, return_inverse=True)
    del every
    at, of = at[first], of[first]
    counts = [np.bincount(group, c, len(first)).astype(np.int64) for c in sums.T]
    for i in range(0, len(first), ROWS_SENT):
        some = slice(i, i + ROWS_SENT)
        grams = [padded[p][a : a + order] for p, a in zip(of[some].tolist(), at[some].tolist())]
        columns = [pa.array(grams, pa.string()), *[pa.array(c[some]) for c in counts]]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "n", *SIDES])


def gram_counts(docs: DataFrame, chosen: DataFrame, order: int) -> DataFrame:
    """Occurrences of every gram in all documents (n) and on each side of the labels.

    A word counts once in a document (in each `CHUNK` of a very long one), so a document
    that repeats a word tells no more of it than any other.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str | None, Counter] = {s: Counter() for s in (None, *SIDES)}
        for batch in batches:
            for text, side in zip(batch.column("text"), batch.column("side").to_pylist()):
                for words in _word_sets(text.as_py()):
                    sides[side].update(words)
                    if sum(map(len, sides.values())) > WORDS_HELD:
                        yield from _gram_batches(sides, order)
        yield from _gram_batches(sides, order)

    rows = _with_side(require(docs, "doc_id", "text").filter("text is not null"), chosen)
    schema = "gram string, n bigint, " + ", ".join(f"{s} bigint" for s in SIDES)
    counted = rows.select("text", "side").mapInArrow(count, schema)
    return counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", *SIDES)])


def _short_model(grams: DataFrame) -> DataFrame:
    """Kneser-Ney probability p of the second letter of every pair of letters (column pair),
    from the different letters seen before it. As many rows as pairs of letters."""
    triples = grams.groupBy(F.expr("right(gram, 3)").alias("triple")).agg(F.sum("n").alias("n"))
    pair, letter = F.expr("right(triple, 2)"), F.expr("right(pair, 1)")
    # What begins a word has nothing but padding before it: there, occurrences count.
    seen = triples.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    pairs = seen.select("pair", F.when(F.col("pair").startswith(START), F.col("n")).otherwise(F.col("kinds")).alias("c"))
    pairs = stage(pairs.withColumns({"letter": letter, "before": F.expr("left(pair, 1)")}))
    letters = pairs.groupBy("letter").agg(F.count("*").alias("c"))
    every = letters.agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    single = letters.join(F.broadcast(every)).select(  # one row
        "letter", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT) / F.col("total")).alias("q")
    )
    contexts = pairs.groupBy("before").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    own = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total")
    return pairs.join(contexts, "before").join(single, "letter").select(
        "pair", (own + DISCOUNT * F.col("kinds") / F.col("total") * F.col("q")).alias("p")
    )


def _discounted(counts: dict[str, int], below: dict[str, float]) -> dict[str, float]:
    """Interpolated Kneser-Ney: the probability of the last letter of each key."""
    total: dict[str, int] = {}
    kinds: dict[str, int] = {}
    for key, c in counts.items():
        total[key[:-1]] = total.get(key[:-1], 0) + c
        kinds[key[:-1]] = kinds.get(key[:-1], 0) + 1
    return {
        key: (max(c - DISCOUNT, 0.0) + DISCOUNT * kinds[key[:-1]] * below[key[1:]]) / total[key[:-1]]
        for key, c in counts.items()
    }


def _group_ratios(order: int):
    """Log ratios of all grams whose last letters but one are the same two."""

    def run(group: pa.Table) -> pa.Table:
        grams = group.column("gram").to_pylist()
        below = {g[-2:]: p for g, p in zip(grams, group.column("p").to_pylist())}
        levels = [dict(zip(grams, group.column("n").to_pylist()))]
        for _ in range(order - 3):
            shorter: dict[str, int] = {}
            for key, c in levels[-1].items():
                shorter[key[1:]] = shorter.get(key[1:], 0) + (c if key[1] == START else 1)
            levels.append(shorter)
        for level in reversed(levels[1:]):
            below = _discounted(level, below)
        counts = np.array([group.column(s).to_numpy() for s in SIDES], float)  # o1, o2, t1, t2
        own = np.flatnonzero(counts.any(axis=0))
        grams = [grams[i] for i in own]
        shared = np.array([below[g[1:]] for g in grams])
        contexts = sorted({g[:-1] for g in grams})
        at = {c: i for i, c in enumerate(contexts)}
        of = np.array([at[g[:-1]] for g in grams], np.int64)
        o1, o2, t1, t2 = counts[:, own]
        by_gram, by_context = [], []
        for ordinary, toxic in ((o1 + o2, t1 + t2), (o1, t1), (o2, t2)):
            logs, rests = [], []
            for c in (toxic, ordinary):
                total = np.bincount(of, c, len(contexts))
                kinds = np.bincount(of, c > 0, len(contexts))
                rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total[of], 1) + rest[of] * shared))
                rests.append(np.log(rest))
            by_gram.append(logs[0] - logs[1])
            by_context.append(rests[0] - rests[1])
        keys = [_hash(_letters("".join(x)), np.arange(len(x)) * size, size) for x, size in ((grams, order), (contexts, order - 1))]
        weights = np.concatenate((by_gram, by_context), axis=1).astype(np.float32)
        key = np.concatenate(keys).view(np.int64)
        return pa.table({"key": key, "w": weights[0], "w1": weights[1], "w2": weights[2]})

    return run


def log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """Rows (key, w, w1, w2): the log of the toxic over the ordinary probability of a gram,
    and of a context's backoff weights for grams that neither class has seen.

    w is of the whole models, w1 and w2 of those of one half. key is the hash of the gram,
    or of the context, which has one letter less. Both models back off to a shared one. All
    that concerns a gram shares the two letters before its last, so a group for each two
    letters holds the counts that the shared model needs, down to those of two letters.
    """
    if order < 4:
        raise ValueError("order must be 4 or more")
    pair = F.expr("right(gram, 2)")
    short = _short_model(grams)
    rows = grams.withColumn("pair", pair).join(short, "pair").withColumn("group", F.expr(f"substring(gram, {order - 2}, 2)"))
    return rows.groupBy("group").applyInArrow(_group_ratios(order), "key bigint, w float, w1 float, w2 float")


def _model(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams and contexts, sorted, and their weights."""
    keys = table.column("key").to_numpy().view(np.uint64)
    weights = np.column_stack([table.column(c).to_numpy() for c in ("w", "w1", "w2")])
    by_key = np.argsort(keys)
    return keys[by_key], weights[by_key]


class _Scorer:
    """Sums of log ratios over texts, for the whole models and those of the halves."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, order: int) -> None:
        self.keys, self.weights, self.order = keys, weights, order
        self.held: defaultdict[str, int] = defaultdict(lambda: len(self.held))
        self.values = np.empty((WORDS_HELD, weights.shape[1]), np.float32)

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of the table, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        # In order, neighbours are looked up in the same part of the table.
        order = np.argsort(wanted)
        at = np.empty(len(wanted), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, wanted[order]), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def _places(self, parts: list[set[str]]) -> np.ndarray:
        """The number of every word. New words get the next numbers."""
        return np.fromiter(map(self.held.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))

    def learn(self, parts: list[set[str]]) -> np.ndarray:
        """The row of `values` of every word, after looking up the words not yet held."""
        first = len(self.held)
        places = self._places(parts)
        if len(self.held) > len(self.values):
            self.held.clear()
            first, places = 0, self._places(parts)
            if len(self.held) > len(self.values):
                self.values = np.empty((len(self.held), self.weights.shape[1]), np.float32)
        for some in _some(list(islice(self.held, first, None))):
            padded, at, of = _gram_places(some, self.order)
            codes = _letters(padded)
            row = self._find(_hash(codes, at, self.order))
            unseen = np.flatnonzero(row < 0)
            row[unseen] = self._find(_hash(codes, at[unseen], self.order - 1))
            found = np.zeros((len(row), self.weights.shape[1]))
            found[row >= 0] = self.weights[row[row >= 0]]
            for i, column in enumerate(found.T):
                self.values[first : first + len(some), i] = np.bincount(of, column, len(some))
            first += len(some)
        return places

    def scores(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The features of each text, a column for each model."""
        parts: list[set[str]] = []  # the different words of a text, or of a chunk of it
        chunks: list[int] = []  # how many parts each text has
        size = 0
        for text in texts:
            chunks.append(0)
            for words in _word_sets(text):
                parts.append(words)
                chunks[-1] += 1
                size += len(words)
            if size > WORDS_SCORED:
                yield from self._features(parts, chunks)
                parts, chunks, size = [], [], 0
        yield from self._features(parts, chunks)

    def _features(self, parts: list[set[str]], chunks: list[int]) -> Iterator[np.ndarray]:
        """Mean measures over the different words; the excesses on a logarithmic scale."""
        of = np.repeat(np.arange(len(chunks)), chunks)
        words = np.zeros(len(chunks))
        total = np.zeros((len(chunks), 1 + len(EXCESS), self.weights.shape[1]))
        first = 0
        while first < len(parts):  # no more at once than are held
            last, size = first, 0
            while last < len(parts) and (last == first or size + len(parts[last]) <= WORDS_HELD):
                size += len(parts[last])
                last += 1
            some = parts[first:last]
            places = self.learn(some)
            rows = self.values[places].astype(float)
            text = np.repeat(of[first:last], list(map(len, some)))
            words += np.bincount(text, minlength=len(chunks))
            for m in range(rows.shape[1]):
                total[:, 0, m] += np.bincount(text, rows[:, m], len(chunks))
                for i, beyond in enumerate(EXCESS, 1):
                    total[:, i, m] += np.bincount(text, np.maximum(rows[:, m] - beyond, 0.0), len(chunks))
            first = last
        mean = total / np.maximum(words, 1)[:, None, None]
        mean[:, 1:] = np.log1p(1000 * mean[:, 1:])
        yield from mean


def measured(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray], order: int, carry: list[str], names: list[str]
) -> DataFrame:
    """The columns `carry` and the features of each text, an array for each column of the
    model's weights (`names`). `docs` has a column text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*held.value, order)
        for batch in batches:
            found = list(scorer.scores(t.as_py() or "" for t in batch.column("text")))
            columns = [batch.column(c) for c in carry]
            columns += [pa.array([f[:, i] for f in found], pa.list_(pa.float64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *names])

    kept = docs.select(*carry).schema.fields
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} array<double>" for n in names]
    return docs.select(*carry, "text").mapInArrow(run, ", ".join(schema))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of a penalised logistic regression, by Newton's method with
    halved steps."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-12)
    z, w = np.column_stack((np.ones(len(x)), x / scale)), np.zeros(x.shape[1] + 1)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + penalty * w @ w / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (p - y) + penalty * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w / np.concatenate(([1.0], scale))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, held_out, score, predicted.

    Labels of held-out documents (CRC-32 of the id, modulo 5, is 0) are not read, and
    nothing but the text is scored. NULL and empty texts score like a text of no weight.
    A NULL doc_id is not held out and has no label. Repeated rows count as often as they
    occur. If the labels have one class alone, every score is the share of toxic labels;
    without labels it is 0.
    """
    texts = require(docs, "doc_id", "text")
    named = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    # Labels of other documents are none.
    chosen = stage(training_labels(labels.join(named, "doc_id", "left_semi"), max_labelled))
    sides = {r["side"]: r["count"] for r in chosen.groupBy("side").count().collect()}
    toxic = sum(n for s, n in sides.items() if s[0] == "t")
    ordinary = sum(sides.values()) - toxic
    plain = texts.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "text",
    )
    if not (toxic and ordinary):
        return _judged(plain.drop("text"), F.lit(toxic / max(toxic + ordinary, 1)))
    spark = docs.sparkSession
    path = write_staged(gram_counts(texts, chosen, order))
    model = _model(log_ratios(spark.read.parquet(path), order).toArrow())
    discard(spark, path)
    # At most `max_labelled` rows, each measured with the half it is not in.
    labelled = texts.join(F.broadcast(chosen), "doc_id")
    keys, weights = model
    sample = measured(labelled, (keys, weights[:, 1:]), order, ["side"], ["x1", "x2"]).toArrow()
    side = np.array(sample.column("side").to_pylist())
    first, second = (np.array(sample.column(c).to_pylist()) for c in ("x1", "x2"))
    other = np.where(np.char.endswith(side, "1")[:, None], second, first)
    curve = logistic(other, np.char.startswith(side, "t").astype(float))
    total = F.lit(float(curve[0]))
    for i, weight in enumerate(curve[1:]):
        total = total + float(weight) * F.col("x")[i]
    scored = measured(plain, (keys, weights[:, :1]), order, ["doc_id", "text_hash", "held_out"], ["x"])
    return _judged(scored, 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0)))))


def _judged(rows: DataFrame, score: Column) -> DataFrame:
    rows = rows.withColumn("score", score.cast("double"))
    return rows.select(
        "doc_id", "text_hash", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without the rows predicted toxic. All columns and other rows stay."""
    scores = toxicity_scores(docs, labels, **options).filter("predicted = 1")
    of, text = unused(docs, "_id", "_hash")
    gone = scores.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text)).distinct()
    same = docs["doc_id"].eqNullSafe(gone[of]) & (F.xxhash64(docs["text"]) == gone[text])
    return docs.join(gone, same, "left_anti")
