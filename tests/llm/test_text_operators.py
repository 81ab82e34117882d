"""Document operators against plain Python on small tables with odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caseflow.llm import decontamination, graph, line_dedup, packing, pii, queries, simhash, toxicity
from caseflow.llm.common import SHUFFLE_CLEANUP, discard_staged, stage

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    words = ["tree", "Stone", "été", "Fox", "ran", "over", "blue", "hill", "x1", "日本"]
    return [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(n)]


def connected(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# Components


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    rows = spark.createDataFrame([*path, *star, (7, 7), (1, 0)], "u bigint, v bigint")
    got = {r.node: r.component for r in graph.components(rows).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


# SimHash


def plain_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TO_LOWER))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    if words and not parts:
        parts = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("chunk", [1 << 20, 16])
def test_fingerprint(monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    for text in [None, "", " \t\n", "one", "A b\x0bC", *texts(3, 60)]:
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)


@pytest.mark.parametrize("block", [4, 20_000])
def test_near_links_connect_what_all_pairs_do(spark, block):
    r = random.Random(5)
    values = {0, 1, 1 << 63}
    for _ in range(12):
        base = r.getrandbits(64)
        values |= {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(25)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    member = graph.components(simhash.near_links(rows, 4, block)).collect()
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    want = connected(len(values), links)
    got = {m.node: m.component for m in member}
    for i, j in [(i, j) for i in range(len(values)) for j in range(i)]:
        same = got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])
        assert same == (want[i] == want[j])


def test_near_duplicate_groups_and_what_stays(documents):
    long = " ".join(texts(9, 20))
    rows = [(5, long), (2, long), (9, long + " end"), (7, None), (3, ""), (None, long), (2, long), (4, "quite another text")]
    docs = documents(rows)
    groups = simhash.near_duplicate_groups(docs, 4, 4)
    got = sorted((r.doc_id or -1, r.component_id) for r in groups.collect())
    prints = {t: plain_fingerprint(t, 4) for _, t in rows}
    assert (prints[long] ^ prints[long + " end"]).bit_count() <= 4
    assert got == [(-1, 2), (2, 2), (2, 2), (3, 3), (4, 4), (5, 2), (7, 3), (9, 2)]
    kept = simhash.keep_one_per_group(docs, 4, 4)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 4]


def test_simhash_of_no_rows(documents):
    assert simhash.keep_one_per_group(documents([]), 4, 4).collect() == []


# Lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.random()
        if kind < 0.3:
            del out[at]
        elif kind < 0.6:
            out.insert(at, r.choice("abé𝄞"))
        else:
            out[at] = r.choice("abé𝄞")
    return "".join(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edits_within(spark, threshold):
    r = random.Random(threshold)
    pairs = []
    for _ in range(300):
        a = "".join(r.choices("abé𝄞", k=r.randint(8, 14)))
        pairs.append((a, edited(r, a, r.randint(0, 4))))
    rows = spark.createDataFrame(pairs, "a string, b string")
    near = line_dedup.edits_within(F.split("a", ""), F.split("b", ""), threshold).alias("near")
    assert [x.near for x in rows.select(near).collect()] == [distance(a, b) <= threshold for a, b in pairs]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_near_lines_finds_every_pair(spark, threshold):
    r = random.Random(threshold)
    lines = sorted({"".join(r.choices("ab", k=r.randint(6, 10))) for _ in range(150)})
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(lines)], "id bigint, n_chars int, line string")
    got = {(x.a, x.b) for x in line_dedup.near_lines(rows, threshold).collect()}
    n = len(lines)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if distance(lines[i], lines[j]) <= threshold}


@pytest.mark.parametrize("common", [10_000, 1])
def test_line_classes(documents, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    line = "the quick brown fox jumps over it"
    near, nearer = line.replace("quick", "quack"), line.replace("quick", "quacky")
    rows = [(4, f"{near}\n\nabc"), (2, f" {line} \nabc\nabc"), (8, nearer), (None, line), (6, None), (7, ""), (9, "xyz\nxyy")]
    got = line_dedup.line_classes(documents(rows)).collect()
    found = sorted((r.doc_id or 99, r.line_no, r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in got)
    assert found == [
        (2, 0, 2, 0, 2, True), (2, 1, 2, 1, 0, True), (2, 2, 2, 1, 0, False), (4, 0, 2, 0, 2, False),
        (4, 2, 2, 1, 0, False), (8, 0, 2, 0, 2, False), (9, 0, 9, 0, 0, True), (9, 1, 9, 1, 0, True),
        (99, 0, 2, 0, 2, False),
    ]


def test_dedup_lines_keeps_rows_and_columns(documents):
    docs = documents([(1, "alpha\n\nbeta"), (2, "beta\ngamma"), (3, "alpha"), (4, None), (2, "beta\ngamma")])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None)
    assert got == [(1, "alpha\n\nbeta", 11), (2, "gamma", 5), (2, "gamma", 5), (3, "", 0)]
    assert line_dedup.dedup_lines(documents([])).collect() == []


def test_two_edits_of_a_line_of_many_words_are_few_edits_of_words(spark):
    """Lines of 62 words and more are linked by their words alone, blanks edited or not."""
    r = random.Random(8)
    for words in (61, 62, 63, 75):
        line = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words))
        blanks = [i for i, c in enumerate(line) if c == " "]
        a, b = blanks[20], blanks[40]
        edited = [line[:a] + line[a + 1 : b] + line[b + 1 :], line[:a] + "x" + line[a + 1 : b] + "y" + line[b + 1 :],
                  line[: a + 2] + " " + line[a + 2 : b + 2] + " " + line[b + 2 :], line[:a] + " " + line[a:]]
        docs = spark.createDataFrame([(0, line), *enumerate(edited, 1)], "doc_id bigint, text string")
        assert {x.doc_id: x.class_doc_id for x in line_dedup.line_classes(docs).collect()} == dict.fromkeys(range(5), 0)


@pytest.mark.parametrize("bits", (20, 4))
def test_near_long_lines_finds_every_pair(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "LETTER_BITS", bits)
    r = random.Random(2)
    lines = []
    for _ in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(15, 100))]
        lines.append(base)
        for _ in range(6):
            line = list(base)
            for _ in range(r.randint(0, len(base) // 12)):
                at = r.randrange(len(line))
                line[at : at + r.randint(0, 1)] = r.choice([[], ["new"], [f"w{r.randrange(400)}"]])
            lines.append(line)
    lines = [list(x) for x in sorted({tuple(x) for x in lines})]
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "id bigint, line string")
    got = {(x.a, x.b) for x in line_dedup.near_long_lines(rows).collect()}
    n = len(lines)
    limit = [len(x) // line_dedup.WORDS_AN_EDIT for x in lines]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if distance(lines[i], lines[j]) <= min(limit[i], limit[j])}
    assert got == want and len(want) > 20 and max(limit[i] for i, _ in want) > 3


def test_chains_of_links_remove_only_what_is_near_a_kept_line(documents):
    lines = [f"Row {'x' * k}{'y' * (40 - k)} of the table" for k in range(41)]  # one edit from step to step
    rows = [(i, f"{line}\nown {i}") for i, line in enumerate(lines)] + [(90, lines[7]), (91, lines[30])]
    got = [r for r in line_dedup.line_classes(documents(rows)).collect() if r.n_chars > 20]
    assert {(r.class_doc_id, r.class_line_no) for r in got} == {(0, 0)}
    text = dict(enumerate(lines)) | {90: lines[7], 91: lines[30]}
    kept = {r.doc_id for r in got if r.kept}
    assert 0 in kept and not kept & {90, 91}
    for i in set(text) - kept:
        assert any(distance(text[i], text[k]) <= line_dedup.THRESHOLD for k in kept)
    assert all(distance(text[i], text[k]) > line_dedup.THRESHOLD for i in kept for k in kept if i < k)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert all((lines[i] in left[i]) == (i in kept) for i in range(41))


def test_independent_nodes(spark):
    r = random.Random(5)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(90)} | {(k, k + 1) for k in range(100, 200)}
    edges = {(u, v) for u, v in edges if u != v}
    rows = spark.createDataFrame(sorted(edges), "u bigint, v bigint")
    taken = [x.node for x in graph.independent(rows, spark.createDataFrame([(100,)], "node bigint")).collect()]
    kept = set(taken)
    assert len(kept) == len(taken) and 100 in kept and not any(u in kept and v in kept for u, v in edges)
    assert {n for e in edges for n in e} - kept <= {v for u, v in edges if u in kept} | {u for u, v in edges if v in kept}
    assert graph.independent(rows.limit(0), rows.selectExpr("u as node")).collect() == []


# Packing


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_over_counts(seed):
    r = random.Random(seed)
    size = r.choice([8, 20, 64])
    histogram = {r.randint(1, size): r.choice([1, 2, 5, 30]) for _ in range(r.randint(0, 12))}
    held, seen = {}, {}
    for length, first, last, sequence, offset in packing.plan(histogram, size):
        assert first == seen.get(length, 0)
        seen[length] = last
        for i in range(last - first):
            held.setdefault(sequence + i, []).append((offset, length))
    assert seen == histogram
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(held) == best_fit([n for n, k in histogram.items() for _ in range(k)], size)


def test_pack_places_every_token(documents, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(texts(4, 40))] + [(50, None), (None, "a b"), (3, "again"), (3, "again"), (51, "word " * 300)]
    rows.append((52, "<|endoftext|> \n\n  x"))
    packed = packing.pack(documents(rows), queries.tokenizer_path(), size=64, with_ids=True).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    want = sorted([i if i is not None else -1, *coder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows)
    pieces = {}
    for p in packed:
        assert p.length == len(p.ids) and (p.piece == 0 or p.length == 64)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        pieces.setdefault((p.doc_id if p.doc_id is not None else -1, p.piece), []).append(p)
    got = []
    for (doc, piece), same in pieces.items():
        if piece == 0:  # of the documents here, those of several pieces occur once
            rest = [x for k in range(1, 99) for p in pieces.get((doc, k), []) for x in p.ids]
            got += [[doc, *p.ids, *rest] for p in same]
    assert sorted(got) == want
    held = {}
    for p in packed:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_both_encoders_agree():
    import public_tokenizers

    fast, plain = (packing.encoder(public_tokenizers.path(f"byte_bpe_50k.{e}")) for e in ("tiktoken", "json"))
    some = ["", "a", "  a  \n\n b\t", "é　x 日本語 𝄞", "it's I'LL 12345 \xa0x \x85", "x" * 3000, *texts(8, 20)]
    assert fast(some) == plain(some)


def test_added_tokens_have_the_ids_of_the_json(spark, documents, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    some = [f"a {end} b", end, f"{end}{end}", f"x \n {end}\n\n it's", f"  {end}  ", "<|endoftext|", f"é　{end}日本", "", *texts(8, 5)]
    paths = [public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("tiktoken", "json")]
    coder = Tokenizer.from_file(paths[1])
    want = [coder.encode(t, add_special_tokens=False).ids for t in some]
    assert want[0] == [64, 220, 50256, 275]
    for path in paths:
        assert packing.encoder(path, added_tokens=True)(some) == want
    documents(list(enumerate(some))).drop("line", "component").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op9_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array([*w, packing.END], "<u4").tobytes())) for i, w in enumerate(want)}


def test_pack_of_no_rows(documents):
    assert packing.pack(documents([]), queries.tokenizer_path()).collect() == []


# Decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))


def plain_report(docs, items, size):
    windows = set()
    for item, text in items:
        w = plain_words(text)
        n = min(len(w), size)
        windows |= {(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc if doc is not None else -1, len(w), len(hit), names, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("slice_size", [1_000_000, 3])
def test_contamination_report(spark, documents, monkeypatch, slice_size):
    monkeypatch.setattr(decontamination, "BROADCAST_GRAMS", slice_size)
    items = [(10, "one two three four five six"), (9, "Blue-hill FOX!"), (8, None), (7, "..."), (6, "one two three four five six"), (None, "zz top")]
    docs = [(1, "x one, two three four five y"), (2, "the blue hill fox. blue hill fox"), (3, None), (4, ""), (None, "zz top"),
            (5, "one two three four"), (5, "one two three four five six"), (1, "x one, two three four five y"),
            *enumerate(texts(2, 20), 100)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination_report(documents(docs), benchmark, 4).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got)
    assert found == plain_report(docs, items, 4)


def test_decontaminate(spark, documents):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    docs = documents([(1, "See Alpha, beta gamma! End"), (2, "alpha beta"), (None, "alpha beta gamma"), (3, None)])
    kept = decontamination.decontaminate(docs, benchmark, 3)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "alpha beta"), (3, "")]
    cut = decontamination.decontaminate(docs, benchmark, 3, remove="spans")
    assert sorted(((r.doc_id or -1), r.text or "") for r in cut.collect()) == [(-1, ""), (1, "See End"), (2, "alpha beta"), (3, "")]
    nothing = decontamination.decontaminate(docs, benchmark.limit(0), 3)
    assert nothing.count() == 4


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_match_the_plain_patterns(documents):
    r = random.Random(1)
    parts = ["a@b.c", "x.y@d-e.f.g", "a@b.c_d@e.f", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.001.0.0", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (255) 555-8013", "+12", "+1+2", "é𝄞", " ", "5", ".", "-", "4111111111111111", "00000000000000"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "1" * 20_000), (903, "a." * 8_000 + "@b" + ".c" * 8_000), (904, "a@b.c " * 700)]
    found = pii.find_personal_data(documents(rows)).select("doc_id", "spans").collect()
    got = {x.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in x.spans if s.kind != "term"] for x in found}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_terms_that_reveal_an_entity(documents):
    rows = [(i, f"Mail of Zorblax number{i}: zorb@x.org please") for i in range(3)]
    rows += [(10 + i, f"please read number{10 + i} of the mail") for i in range(30)]
    docs = documents(rows)
    terms = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert "zorblax" in terms and not terms & {"please", "mail"}
    found = pii.find_personal_data(docs)
    texts_ = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    assert texts_[0] == "Mail of  number0: [EMAIL] please" and texts_[10] == "please read number10 of the mail"
    alone = pii.find_personal_data(documents(rows[:1])).collect()
    assert [s.kind for s in alone[0].spans] == ["email"]
    again = documents([*rows, rows[0], rows[0], (90, rows[0][1]), rows[10]])
    assert {r.term for r in pii.disclosing_terms(again).collect()} == terms


def test_query_digest_of_no_spans(spark, documents, tmp_path):
    documents([(1, "plain")]).write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.op7_pii(spark, str(tmp_path)).first()
    assert (row.n_email, row.spans, row.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# Toxicity


def toxic_rows(n, seed=0):
    r = random.Random(seed)
    plain = ["river", "stone", "light", "paper", "garden", "window", "summer", "early", "market", "letter"]
    rows, marks = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randint(20, 60))
        toxic = int(r.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), "grok" + r.choice(["ul", "an", "ist", "ep"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    return rows, marks


def test_toxicity_on_held_out_documents(spark, documents):
    rows, marks = toxic_rows(400)
    odd = [(1_000, None), (1_001, ""), (None, "grokul"), (7, rows[7][1])]
    labels = spark.createDataFrame([*marks, (1_000, 1, None)], "doc_id bigint, quality int, toxic int")
    scores = toxicity.toxicity_scores(documents([*rows, *odd]), labels).collect()
    assert len(scores) == 404 and all(0 <= s.score <= 1 and s.predicted == int(s.score >= 0.5) for s in scores)
    truth = {i: t for i, _, t in marks}
    held = [s for s in scores if s.held_out and s.doc_id in truth]
    assert {s.doc_id for s in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(s.predicted == truth[s.doc_id] for s in held) >= 0.95 * len(held)
    kept = toxicity.reject_toxic(documents(rows), labels)
    assert {r.doc_id for r in kept.collect()} == {s.doc_id for s in scores if s.doc_id in truth and not s.predicted}


def test_held_out_labels_are_not_read(spark, documents):
    rows, marks = toxic_rows(120, seed=3)
    docs = documents(rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    a, b = (
        {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, spark.createDataFrame(m, "doc_id bigint, quality int, toxic int")).collect()}
        for m in (marks, turned)
    )
    assert a == b


def test_toxicity_without_labels_or_with_one_class(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(docs, one).collect()} == {1}


def test_grams_count_once_a_document(spark, documents):
    docs = documents([(1, "ab ab"), (2, "AB c"), (3, None), (4, "d" * 600)])
    side = spark.createDataFrame([(1, "o1"), (2, "t2")], "doc_id bigint, side string")
    got = {r.gram: (r.n, r.o1, r.t2) for r in toxicity.gram_counts(docs, side, 2).collect()}
    assert got["\x02a"] == (2, 1, 1) and got["b\x03"] == (2, 1, 1) and got["c\x03"] == (1, 0, 1)
    assert got["dd"] == (255 + 87, 0, 0)  # the word is cut into two different ones


def test_keys_that_the_same_lines_share_are_one(spark):
    rows = [(k, i, True) for k in range(5) for i in (1, 2, 3)] + [(9, 1, True), (9, 2, True), (10, 1, True), (10, 1, True)]
    got = line_dedup.shared_keys(spark.createDataFrame(rows, "key bigint, id bigint, found boolean")).collect()
    assert {(r.key, r.id) for r in got} == {(0, 1), (0, 2), (0, 3), (9, 1), (9, 2)} and len(got) == 5


def test_words_are_numbered_and_looked_up_in_one_pass(monkeypatch):
    """However often the table of words is emptied, a word has the sum of its grams."""
    order, r = 4, random.Random(6)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(50)]
    padded, at, _ = toxicity._gram_places(words[:25], order)
    grams = {padded[i : i + order] for i in at}
    keys = np.array([toxicity._hash(toxicity._letters(g), np.zeros(1, int), order)[0] for g in grams])
    by_key = np.argsort(keys)
    weights = np.arange(1.0, 1 + len(keys), dtype=np.float32)[:, None]
    weight = dict(zip(np.array(list(grams))[by_key].tolist(), weights[:, 0].tolist()))
    for held in (7, 500):
        monkeypatch.setattr(toxicity, "WORDS_HELD", held)
        scorer = toxicity._Scorer(keys[by_key], weights, order)
        for _ in range(20):
            parts = [set(r.sample(words, r.randint(0, 6))) for _ in range(r.randint(1, 3))]
            places = scorer.learn(parts)
            got = scorer.values[places][:, 0].tolist()
            padded = [toxicity.START * (order - 1) + w + toxicity.END for p in parts for w in p]
            assert got == [sum(weight.get(p[i : i + order], 0) for i in range(len(p) - order + 1)) for p in padded]


def test_pairs_that_meet_by_many_keys_meet_once(spark, monkeypatch):
    """In blocks and whole: every pair of lines of 80 words that share runs is one row."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    lines = []
    for i in range(12):
        line = list(base)
        line[r.randrange(80)] = f"new{i}"
        lines.append((i, " ".join(line)))
    rows = spark.createDataFrame(lines, "id bigint, line string")
    made = []
    sides = line_dedup._sides
    monkeypatch.setattr(line_dedup, "_sides", lambda *a: made.append(sides(*a).count()) or sides(*a))
    for block in (5, 256):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        assert line_dedup.near_long_lines(rows).count() == 66
    assert made == [66] * 4


def test_links_of_near_copies_are_counted_without_a_row_for_each(documents, monkeypatch):
    """Copies of a line of 80 words (5 edits) with 1 to 4 words edited, and a few other lines."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    lines = [base, base[:30], base[:29] + ["other"]]
    for i in range(60):
        line = list(base)
        for at in r.sample(range(80), (1, 1, 1, 1, 2, 2, 3, 4)[i % 8]):
            line[at : at + r.randint(0, 1)] = r.choice([[], [f"new{i}"], [f"w{r.randrange(80)}"]])
        lines.append(line)
    lines = [list(x) for x in sorted({tuple(x) for x in lines})]
    n, k = len(lines), [len(x) // line_dedup.WORDS_AN_EDIT for x in lines]
    near = {i: {j for j in range(n) if i != j and distance(lines[i], lines[j]) <= min(k[i], k[j])} for i in range(n)}
    made, sides = [], line_dedup._sides
    monkeypatch.setattr(line_dedup, "_sides", lambda *a: made.append(sides(*a).count()) or sides(*a))
    got = line_dedup.line_classes(documents([(i, " ".join(x)) for i, x in enumerate(lines)])).collect()
    assert {x.doc_id: x.n_links for x in got} == {i: len(near[i]) for i in range(n)}
    assert made[-1] * 4 < sum(map(len, near.values())) // 2
    kept = {x.doc_id for x in got if x.kept}
    assert not any(near[i] & kept for i in kept) and all(near[i] & kept for i in range(n) if i not in kept)


def test_independent_nodes_by_groups_are_those_by_edges(spark):
    r = random.Random(12)
    group = {i: r.randrange(6) for i in range(60)}
    linked = {(g, h) for g in range(6) for h in range(6) if (g * h) % 3 == 1 or (g + h) % 5 == 4}
    listed = {tuple(r.sample(range(80), 2)) for _ in range(50)}
    told = {(i, j) for i in group for j in group if i < j and (group[i], group[j]) in linked}
    edges = lambda rows: spark.createDataFrame(sorted(rows), "u bigint, v bigint")
    first = spark.createDataFrame([(3,), (70,)], "node bigint")
    members = spark.createDataFrame(sorted(group.items()), "node bigint, group int")
    near = spark.createDataFrame(sorted(linked), "group int, near int")
    got = {x.node for x in graph.independent(edges(listed), first, members, near).collect()}
    want = {x.node for x in graph.independent(edges(listed | told), first).collect()}
    assert got - set(group) == want - set(group) and want <= got
    assert all(i not in {x for e in listed | told for x in e} for i in got - want)


def test_gram_batches_are_small_and_count_every_gram(monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS_SENT", 10)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 3)
    order, r = 4, random.Random(5)
    words = ["".join(r.choice("ab\x00\u00e9") for _ in range(r.randint(1, 6))) for _ in range(60)]
    sides = {s: Counter(r.choices(words, k=20)) for s in (None, *toxicity.SIDES)}
    wanted: dict = {}
    for side, counter in sides.items():
        for word, n in counter.items():
            padded = toxicity.START * (order - 1) + word + toxicity.END
            for i in range(len(padded) - order + 1):
                row = wanted.setdefault(padded[i : i + order], Counter())
                row.update({"n": n} | ({side: n} if side else {}))
    batches = list(toxicity._gram_batches(sides, order))
    assert max(b.num_rows for b in batches) <= 10
    rows = [row for b in batches for row in b.to_pylist()]
    assert {row["gram"]: {c: row[c] for c in ("n", *toxicity.SIDES)} for row in rows} == {
        g: {c: counts[c] for c in ("n", *toxicity.SIDES)} for g, counts in wanted.items()
    }
    assert len(rows) == len(wanted) and not any(sides.values())
    assert list(toxicity._gram_batches(sides, order)) == []


def test_shuffles_of_a_staged_result_are_removed(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = shuffled()
    staged = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and staged.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    files = staged.inputFiles()
    discard_staged(staged)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_near_copies_are_compared_with_the_text_they_were_made_from(documents, monkeypatch):
    """Most copies have a word more: none of them is the center."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    lines = [" ".join(base)]
    for i in range(30):
        line = list(base)
        at = r.randrange(80)
        line[at : at + (i % 4 == 0)] = [f"new{i}"]
        lines.append(" ".join(line))
    centers, stars = [], line_dedup.word_stars

    def seen(*a):
        made = stars(*a)
        centers.extend(x.center for x in made.collect())
        return made

    monkeypatch.setattr(line_dedup, "word_stars", seen)
    docs = documents(list(enumerate(lines)))
    assert {x.n_links for x in line_dedup.line_classes(docs).collect()} == {30}
    own = docs.filter("doc_id = 0").select(F.xxhash64("text")).first()[0]
    assert len(centers) == 31 and set(centers) == {own}
