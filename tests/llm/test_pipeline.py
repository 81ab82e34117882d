"""The pipeline against plain Python: every stage's decisions, and the last one's places."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from caseflow.llm import line_dedup, queries, toxicity
from tests.llm.test_text_operators import best_fit, connected, distance, plain_fingerprint, plain_words, toxic_rows


def deduped(rows):
    """Lines that are equal to, or linked over near lines with, an earlier one go."""
    lines = [(i, k, line.strip(line_dedup.BLANKS)) for i, t in sorted(rows) for k, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    links = []
    for a, (_, _, x) in enumerate(lines):
        for b, (_, _, y) in enumerate(lines[:a]):
            long = min(len(x), len(y)) >= line_dedup.MIN_CHARS and abs(len(x) - len(y)) <= line_dedup.THRESHOLD
            if x == y or long and distance(x, y) <= line_dedup.THRESHOLD:
                links.append((a, b))
    first = connected(len(lines), links)
    gone = {lines[n][:2] for n in range(len(lines)) if first[n] != n}
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]


def test_pipeline_against_plain_python(spark, documents, tmp_path):
    rows, marks = toxic_rows(90, seed=8)
    rows = [(i, t[: len(t) // 2] + "\n" + t[len(t) // 2 :]) for i, t in rows]
    line = "a line that stands in several of the documents here"
    rows += [(200, f"{line}\nand one more of it"), (201, f"{line.replace('several', 'severel')}\nother words follow"), (202, rows[1][1])]
    rows += [(203, "we cite: the answer to all of these questions is known by now to anybody who asks"), (204, "")]
    items = [(1, "the answer to all of these questions is known by now")]
    documents(rows).drop("line", "component").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    scores = toxicity.toxicity_scores(documents(rows), labels).collect()
    toxic = {r.doc_id for r in scores if r.predicted}
    left = deduped([r for r in rows if r[0] not in toxic])
    prints = [plain_fingerprint(t, queries.SHINGLE) for _, t in left]
    n = len(left)
    near = [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= queries.DISTANCE]
    groups = connected(n, near)
    least = {g: min(left[k][0] for k in range(n) if groups[k] == g) for g in groups}
    left = [x for k, x in enumerate(left) if x[0] == least[groups[k]]]
    window = " ".join(plain_words(items[0][1])[:10])
    left = [(i, t) for i, t in left if window not in " ".join(plain_words(t))]
    assert 203 not in dict(left) and toxic

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in packed} == lengths
    assert len({r.sequence_id for r in packed}) == best_fit(lengths.values(), 2048)
