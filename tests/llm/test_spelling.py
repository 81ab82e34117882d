from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from caseflow.llm import spelling


def edits_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def forms_by_hand(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in words if edits_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def invented(seed: int, count: int) -> dict[str, int]:
    """Words over few letters, so that many are near, with some that share a long prefix."""
    rand = random.Random(seed)
    words = set()
    while len(words) < count:
        base = "".join(rand.choice("abÀé") for _ in range(rand.randint(5, 9)))
        words.add(rand.choice(["", "", "prefix", "aaaaaaaa"]) + base)
    return {w: rand.choice([3, 3, 4, 6, 9, 12, 30, 200]) for w in words}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("block", "queries"), [(8192, 32768), (40, 32768), (7, 5)])
def test_forms_are_those_of_brute_force(spark, block, queries):
    words = invented(block, 700)
    words |= {"solos" * 150: 3, "solos" * 150 + "x": 7, "x" + "solos" * 150: 14}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert result(spelling.variant_forms(df, block, queries)) == forms_by_hand(words)


def test_chains_of_forms_lead_to_their_end(spark):
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(20)}
    df = spark.createDataFrame(list(chain.items()), "word string, n bigint")
    got = result(spelling.variant_forms(df, 8, 8))
    assert got == forms_by_hand(chain)
    assert {v[1] for v in got.values()} == {"aaaaa" + "b" * 19}


def words_by_hand(rows) -> dict[str, int]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_and_forms_of_documents(spark, documents):
    rand = random.Random(3)
    pool = ["Straße", "STRASSE", "Été", "étés", "Ångström", "naïve", "naive", "Über", "plain", "plains", "don't", "a×b÷c", "x1y2", "\U0001d400bcdef"]
    rows = [(i if i % 50 else None, " ".join(rand.choice(pool) + rand.choice(["", "s", "en", "ing"]) for _ in range(rand.randint(0, 60)))) for i in range(400)]
    rows += [(9000, None), (9001, ""), (9002, "abcde" * 50_000), (9003, "abcde" * 50_000), (9004, "abcde" * 50_000), *[rows[0]] * 3]
    docs = documents(rows)
    words = words_by_hand(rows)
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == words
    assert any("abcde" * 50_000 == w for w in words)
    assert result(spelling.variant_forms(spelling.vocabulary(docs))) == forms_by_hand(words)


def test_no_words(spark, documents):
    assert spelling.variant_forms(spelling.vocabulary(documents([(1, None), (2, "a b c")]))).count() == 0


def test_a_scan_finds_what_comparing_finds_and_skips_the_rest():
    words = sorted(invented(1, 500))
    listed = spelling.SortedList(words)
    for i, word in enumerate(words):
        assert listed.scan(word, 0, len(words), 0, 0, True) == [j for j, v in enumerate(words) if edits_one(word, v)]
        starts = listed.scan(word, 0, len(words), 0, 0, False)
        assert {j for j, v in enumerate(words) if edits_one(word, v)} <= set(starts)
