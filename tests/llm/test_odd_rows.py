"""One bad row, or a column of a clashing name, stops no query."""

from __future__ import annotations

import time

import pytest

from caseflow.llm import decontamination, exact_dedup, html_text, line_dedup, packing, queries, simhash, toxicity
from caseflow.llm.dom import block_tree

CLASHING = ("_id", "_hash", "_gone", "_spans", "_sha256", "_chars", "__id")


def texts_of(page):
    nodes, _ = block_tree(page)
    return " ".join(" ".join("".join(p for p in n.pieces if isinstance(p, str)) for n in nodes).split())


@pytest.mark.parametrize("odd", ["<![foo[bar]]>", "<![CDATA[x]]>", "<![", "<!", "<svg/>", "<math />", "<!foo>", "<?x y?>"])
def test_odd_markup_leaves_the_text_around_it(odd):
    assert texts_of(f"<p>before {odd}</p><p>after</p>").startswith("before")
    if odd.endswith(">"):
        assert texts_of(f"<p>before {odd} and</p><p>after</p>") == "before and after"


def test_a_map_is_read():
    assert texts_of("<map name=m><p>A way there</p></map>") == "A way there"


@pytest.mark.parametrize("junk", ["<a ", '<a x="', "</a ", "<!x "])
def test_unclosed_junk_is_read_in_linear_time(junk):
    start = time.perf_counter()
    assert texts_of("<p>text</p>" + junk * 120_000) == "text"
    assert time.perf_counter() - start < 5


def test_a_page_of_odd_markup_does_not_stop_the_others(spark):
    rows = [(1, "u", "<p>One <![foo[bar]]> text of some length, with words.</p>"), (2, "u", "<a " * 200_000), (3, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id for r in html_text.extract_main_text(pages).collect()} == {1, 2, 3}


@pytest.mark.parametrize("blank", [" ", "\n", " \t"])
def test_a_million_blanks_have_the_ids_of_the_json_tokenizer(spark, blank):
    path = queries.tokenizer_path()
    text = "a" + blank * (1_200_000 // len(blank)) + "b <|endoftext|>"
    other = packing.encoder(path.removesuffix(".tiktoken") + ".json", True)
    assert packing.encoder(path, True)([text, "x y"]) == [list(x) for x in other([text, "x y"])]


def test_a_document_of_blanks_is_packed(spark, documents):
    rows = packing.pack(documents([(1, "a" + " " * 1_200_000 + "b"), (2, "c")]), queries.tokenizer_path(), added_tokens=True).collect()
    assert {r.doc_id for r in rows} == {1, 2}


def test_labels_without_documents_are_none(spark, documents):
    labels = spark.createDataFrame([(900 + i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    scores = toxicity.toxicity_scores(documents([(1, "some words"), (2, None)]), labels).collect()
    assert [(r.score, r.predicted) for r in scores] == [(0.0, 0)] * 2
    assert toxicity.toxicity_scores(documents([]), labels).collect() == []


def test_labelled_documents_without_a_word(spark, documents):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    scores = toxicity.toxicity_scores(documents([(i, None if i % 3 else "") for i in range(40)]), labels).collect()
    assert len(scores) == 40 and all(0 <= r.score <= 1 for r in scores)


def test_stages_keep_columns_of_clashing_names(spark):
    names = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(i, f"words of text number {i} that no other has, {i * 7919}\nand a second line of it {i}", *"abcdefg") for i in range(12)]
    rows.append((50, rows[0][1], *"abcdefg"))
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, rows[3][1])], "item_id bigint, text string")
    for left in (
        toxicity.reject_toxic(docs, labels),
        line_dedup.dedup_lines(docs),
        simhash.keep_one_per_group(docs, 4, 4),
        decontamination.decontaminate(docs, benchmark),
        decontamination.decontaminate(docs, benchmark, remove="spans"),
        exact_dedup.drop_duplicates(docs),
    ):
        assert left.columns == docs.columns
        assert {tuple(r)[2:] for r in left.collect()} <= {tuple("abcdefg")}
