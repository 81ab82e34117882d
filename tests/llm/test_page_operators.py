"""Operators on pages, URLs and vectors against plain Python, with odd rows."""

from __future__ import annotations

import datetime
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import html_text, nn_descent, url_filter, warc
from caseflow.llm.dom import _Builder, block_tree
from caseflow.llm.labelled_pages import labelled_pages


@pytest.fixture
def pages(spark):
    def make(rows):
        schema = "page_id bigint, url string, html string, digest string, head int"
        return spark.createDataFrame([(*r, "x", 1) for r in rows], schema)

    return make


# Main text


def test_marginals_are_those_of_all_labellings():
    nodes, _ = block_tree('<div class="menu"><p>a</p></div><article><p>Some words.</p><h2>b</h2></article>')
    r = np.random.default_rng(0)
    weights = r.normal(size=html_text.N_WEIGHTS).tolist()
    found = html_text.features(nodes)
    n = len(nodes)
    single, both, total = np.zeros(n), np.zeros(n), 0.0
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        score = sum(weights[k] for i in range(n) if y[i] for k in found[i])
        for i in range(1, n):
            score += weights[html_text.N_FEATURES + 4 * html_text._tag(nodes[i]) + 2 * y[nodes[i].parent] + y[i]]
        p = np.exp(score)
        total += p
        single += p * np.array(y)
        both += p * np.array([y[i] * y[max(nodes[i].parent, 0)] for i in range(n)])
    got, pairs = html_text.marginals(nodes, found, weights)
    assert np.allclose(got, single / total)
    assert np.allclose([p[3] for p in pairs[1:]], (both / total)[1:])


def test_held_out_labelled_pages():
    weights = html_text.default_weights()
    wrong = blocks = 0
    for page in labelled_pages(60, seed=77):
        nodes, marked = block_tree(page)
        single, _ = html_text.marginals(nodes, html_text.features(nodes), weights)
        for i, node in enumerate(nodes):
            blocks += bool(node.chars)
            wrong += bool(node.chars) and (single[i] >= 0.5) != (i in marked)
    assert wrong <= 0.02 * blocks


def test_extract_main_text(pages):
    article = "<article><h1>A &amp; B</h1><p>First  line\nof <b>te</b>xt.<p>Second &lt;one&gt;.</article>"
    menu = '<nav><ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul></nav>'
    page = f'<html><head><title>T</title><script>var a="</p><p>no";</script></head><body>{menu}{article}<footer>&copy; x</footer>'
    deep = "<div>" * 3_000 + "<p>A deep sentence stands here, long enough to read.</p>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "v", page), (4, "w", "<<<>&"), (5, "d", deep), (1, "u", page)]
    got = html_text.extract_main_text(pages(rows)).collect()
    want = "A & B First line of text. Second <one>."
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == 7 and [r.text for r in got].count(want) == 3
    assert by[2, None].text == by[3, "u"].text == "" and by[2, None].n_chars == 0
    assert by[1, "u"].n_chars == len(want)
    assert html_text.extract_main_text(pages([])).collect() == []


def plain_text(html):
    return " ".join(" ".join(p for n in block_tree(html)[0] for p in n.pieces if isinstance(p, str)).split())


@pytest.mark.parametrize("start", ["<body>", "<body class=x>", "", "<p>", "<br>", "<svg></svg>"])
def test_head_without_end_tag(start):
    head = "<html><head><title>T</title>\n<meta charset=utf-8><style>p {}</style><link rel=x><script>var a</script>"
    nodes, _ = block_tree(f"{head}{start}Some <b>text</b>.<div>More</div></body></html>")
    assert "div" in [n.tag for n in nodes]
    assert plain_text(f"{head}{start}Some <b>text</b>.<div>More</div></body></html>") == "Some text . More"
    assert plain_text(f"{head}<noscript>n<img src=x>m</noscript></head>{start}x") == "x"


def test_main_text_of_a_page_without_head_end(pages):
    page = "<html><head><title>T</title><body><article><h1>A title</h1><p>First text of it.<p>Second one.</article></body></html>"
    assert [r.text for r in html_text.extract_main_text(pages([(1, "u", page)])).collect()] == ["A title First text of it. Second one."]


@pytest.mark.parametrize("form", ["<option>{}", "<optgroup label=x><option>{}", "<b>{}", "<option><i>{}"])
def test_end_tags_close_elements_at_any_depth(form):
    many = "".join(form.format(k) for k in range(700))
    nodes, _ = block_tree(f"<section><form><select>{many}</select></form><p>After.</p></section><footer>End.</footer>")
    by = {n.tag: n for n in nodes}
    assert plain_text(f"<div><select>{many}</select>After.</div>") == "After."
    assert by["p"].pieces == ["After."] and nodes[by["p"].parent].tag == "section"
    assert by["footer"].pieces == ["End."] and by["footer"].parent == 0


def test_blocks_close_over_unclosed_line_level_elements():
    nodes, _ = block_tree(f"<article><p>One.{'<i>' * 700}two<p>Three.</article></b><footer>End.</footer>")
    tags = [(n.tag, nodes[n.parent].tag) for n in nodes[1:]]
    assert tags == [("article", "html"), ("p", "article"), ("p", "article"), ("footer", "html")]


def test_options_end_open_options():
    builder = _Builder()
    builder.feed("<select><option>a<option>b<optgroup><option>c<option>d<optgroup><option>e")
    assert [t for t, _ in builder.open] == ["select", "optgroup", "option"]


# WARC


def test_archive_round_trip(spark, pages, tmp_path):
    long, other = "<p>é</p>" * 40, "x" * 100
    rows = [(5, "http://b", long), (3, "http://a\r\nWARC/1.1", long), (9, None, long), (None, "http://n", long), (1, "s", "short"),
            (2, "s", "short"), (4, "o", other), (4, "o", other), (6, "z", None), (7, "z", ""), (8, "w", f"{other}\r\n\r\nWARC/1.1\r\n")]
    folder = warc.write_archive(pages(rows), f"{tmp_path}/archive")
    records = warc.read_records(spark, folder)
    whole = warc.reconstruct(records).collect()
    assert len(whole) == len(rows)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload, r.bytes) for r in whole)
    kind = {5: ("revisit", 3), 3: ("response", -1), 9: ("revisit", 3), -1: ("revisit", 3)}
    want = []
    for i, _, html in rows:
        i = i or -1
        html = html or ""
        k, refers = kind.get(i, ("response", -1))
        if i == 4 and any(w[0] == 4 for w in want):
            k, refers = "revisit", 4
        want.append((i, k, refers, html, len(html.encode())))
    assert got == sorted(want)
    assert all(hashlib.sha256(r.payload.encode()).hexdigest() == r.digest for r in whole)
    assert records.filter("payload is not null").groupBy("digest").count().filter("count > 1").count() == 2  # the short ones
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "archive").glob("*.gz")))
    assert data.count(b"WARC-Record-ID: ") == len(rows) and data.endswith(b"\r\n\r\n")


def test_damaged_archives_are_errors():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.parse(gzip.compress(good * 2))) == [(good[:-11], b"abc")] * 2
    for bad in (good[:-6], good.replace(b"abc", b"abcd"), b"junk"):
        with pytest.raises(ValueError):
            list(warc.parse(gzip.compress(bad)))
    assert list(warc.parse(gzip.compress(b""))) == []


def test_archive_of_no_pages(spark, pages, tmp_path):
    assert warc.reconstruct(warc.read_records(spark, warc.write_archive(pages([]), f"{tmp_path}/a"))).collect() == []


# URL filter

DAY = datetime.datetime(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_judge_captures(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_INTERVALS", broadcast)
    entries = [
        ("a", "domain", "bad.org", day(10), "block"), ("a", "domain", "bad.org", day(20), "off"),
        ("a", "domain", "bad.org", day(30), "block"), ("b", "host", "good.bad.org", day(12), "allow"),
        ("b", "prefix", "good.bad.org/x/", day(14), "block"), ("c", "host", "twice.com", day(1), "block"),
        ("c", "host", "twice.com", day(1), "allow"), ("d", "host", "twice.com", day(1), "allow"),
        ("a", None, "x.com", day(1), "block"), ("a", "host", "off.com", day(1), "off"), ("a", "host", "", day(1), "block"),
    ]
    captures = [
        (1, "http://bad.org/", day(9), "unlisted", 0), (2, "http://U@www.BAD.org.:80/p?q", day(10), "block", 1),
        (3, "http://bad.org", day(20), "unlisted", 0), (4, "https://bad.org#a", day(35), "block", 1),
        (5, "http://good.bad.org/x/y", day(13), "allow", 2), (6, "http://good.bad.org/x/y", day(15), "block", 3),
        (7, "http://good.bad.org/xy", day(15), "allow", 2), (8, "http://twice.com", day(2), "block", 2),
        (9, None, day(11), "unlisted", 0), (10, "http://bad.org", None, "unlisted", 0), (11, "bad.org", day(11), "unlisted", 0),
        (12, "http://off.com", day(5), "unlisted", 0), (13, "http://" + "a." * 200 + "bad.org", day(11), "unlisted", 0),
        (2, "http://U@www.BAD.org.:80/p?q", day(10), "block", 1), (None, "http://notbad.org/", day(11), "unlisted", 0),
    ]
    listed = spark.createDataFrame(entries, "list string, kind string, value string, listed_at timestamp, status string")
    rows = spark.createDataFrame([(*c[:3], "clash") for c in captures], "page_id bigint, url string, fetched_at timestamp, host string")
    got = url_filter.judge_captures(rows, listed).collect()
    assert sorted((r.page_id or -1, r.verdict, r.n_active) for r in got) == sorted((c[0] or -1, c[3], c[4]) for c in captures)
    kept = url_filter.filter_captures(rows, listed).count()
    assert kept == sum(c[3] != "block" for c in captures)
    assert {r.verdict for r in url_filter.judge_captures(rows, listed.limit(0)).collect()} == {"unlisted"}
    assert url_filter.judge_captures(rows.limit(0), listed).collect() == []


# Nearest neighbours


def exact(rows, queries, k):
    out = set()
    for q, v in rows:
        if queries(q):
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out |= {(q, n, i) for n, (_, i) in enumerate(scored, 1)}
    return out


def test_few_vectors_are_searched_whole(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-4, 5, 6).astype(float).tolist()) for i in range(24)]
    rows += [(30 + i, rows[3][1]) for i in range(8)]
    odd = [(50, None), (51, [0.0] * 6), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (53, [float("nan")] * 6), (None, rows[0][1]),
           (54, [1.0, 2.0]), (55, [float("inf")] * 6)]
    vectors = spark.createDataFrame([(*x, 1, "c") for x in [*rows, *odd, rows[5]]], "vec_id bigint, embedding array<double>, id int, code string")
    got = nn_descent.nearest_neighbours(vectors, F.col("vec_id") % 5 == 0, 4).collect()
    assert {(g.query_id, g.rank, g.vec_id) for g in got} == exact(rows, lambda q: q % 5 == 0, 4)
    by_id = dict(rows)
    assert all(abs(g.score - np.dot(by_id[g.query_id], by_id[g.vec_id])) < 1e-12 for g in got)
    assert nn_descent.nearest_neighbours(vectors.limit(0), F.col("vec_id") % 5 == 0, 4).collect() == []


def test_recall(spark):
    r = np.random.default_rng(4)
    points = r.normal(size=(900, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nn_descent.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, 10).collect()
    want = {(q, i) for q, _, i in exact(rows, lambda q: q % 20 == 0, 10)}
    assert len({(g.query_id, g.vec_id) for g in got} & want) >= 0.9 * len(want)


def test_small_clusters_far_from_the_rest_find_as_many(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "ASKING", 16)  # queries are dealt to many groups
    r = np.random.default_rng(6)
    points = r.normal(size=(1_500, 12))
    points[:10] = 40 + r.normal(size=(10, 12)) / 50
    points[10:18] = -40 + r.normal(size=(8, 12)) / 50
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(2_000 + i, points[0].tolist()) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nn_descent.nearest_neighbours(vectors, F.col("vec_id") % 10 == 0, 20).collect()
    asked = [i for i, _ in rows if i % 10 == 0]
    assert sorted((g.query_id, g.rank) for g in got) == [(q, n) for q in asked for n in range(1, 21)]
    want = {(q, i) for q, _, i in exact(rows, lambda q: q % 10 == 0, 20)}
    assert len({(g.query_id, g.vec_id) for g in got} & want) >= 0.9 * len(want)


def test_a_step_of_the_walks_has_a_row_for_a_query_and_bucket(spark, monkeypatch):
    """And not one for each node that a query looks at."""
    score = nn_descent._score

    def few_rows(beam):
        run = score(beam)

        def checked(group):
            assert group.num_rows <= 300 + 15, group.num_rows
            return run(group)

        return checked

    monkeypatch.setattr(nn_descent, "_score", few_rows)
    monkeypatch.setattr(nn_descent, "BUCKET", 100)
    r = np.random.default_rng(8)
    rows = [(i, p.tolist()) for i, p in enumerate(r.normal(size=(300, 8)))]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nn_descent.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, 5).collect()
    want = {(q, i) for q, _, i in exact(rows, lambda q: q % 20 == 0, 5)}
    assert len({(g.query_id, g.vec_id) for g in got} & want) >= 0.9 * len(want)


def test_ids_are_hashed_as_spark_hashes_them(spark):
    ids = [0, 1, -1, 7, 2**62 + 5, -(2**63), 2**63 - 1, 123_456_789]
    want = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", F.xxhash64("id")).collect()
    assert dict(zip(ids, nn_descent._hashed(np.array(ids)).tolist())) == dict(map(tuple, want))
