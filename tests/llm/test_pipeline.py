import numpy as np
import pytest
import sentencepiece as library

import corpus_pipeline
import __spark_entry__
from lodestar.llm import exact_dedup, sentencepiece, toxicity
from lodestar.llm.common import table
from tests.llm.test_dedup import plain_fingerprint


def plainly(text):
    """Letters and digits in lower case, with single spaces between."""
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def holds(text, item, share=0.15):
    """Is some passage of text within share * len(item) edits of item? A passage keeps one of most + 1 pieces; where one
    occurs, the table of edit distances decides."""
    most = int(share * len(item))
    cuts = [k * len(item) // (most + 1) for k in range(most + 2)]
    at = [i for a, b in zip(cuts, cuts[1:]) for i in range(len(text)) if b > a and text.startswith(item[a:b], i)] if any(item[a:b] in text for a, b in zip(cuts, cuts[1:])) else []
    if not at:
        return False
    text = text[max(0, min(at) - len(item) - most) : max(at) + 2 * len(item) + most]
    places = np.arange(len(text) + 1)
    codes, row = np.array([ord(c) for c in text]), np.zeros(len(text) + 1, np.int64)
    for k, c in enumerate(item, 1):
        new = np.concatenate([[k], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(new - places) + places
    return row.min() <= most


def test_pipeline_against_brute_force(spark, sf_dir):
    """Only the classifier's model is the library's own; the other stages are done again by other means."""
    docs = [r.asDict() for r in table(spark, sf_dir, "documents").collect()]
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    docs = [d for d, s in zip(docs, model.scores([d["text"] for d in docs])) if s < 0.5]
    last = {}
    for d in docs:
        if d["text"] not in last or last[d["text"]]["doc_id"] < d["doc_id"]:
            last[d["text"]] = d
    docs = sorted(last.values(), key=lambda d: d["doc_id"])
    prints, root = [plain_fingerprint(d["text"]) for d in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = [d for i, d in enumerate(docs) if find(i) == i]
    items = [plainly(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = [d for d in docs if not any(holds(plainly(d["text"]), item) for item in items)]
    encoder = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    got = {r.doc_id: (r.ids, r.round_trip) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d["doc_id"]: (encoder.encode(d["text"]), True) for d in docs}


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def test_toxicity_stage_takes_rows_of_any_kind(spark, sf_dir, model):
    """Null ids and texts, repeated rows and clashing names stay as they are; no table, no rows."""
    rows = [(1, "a plain text", "x"), (1, "a plain text", "x"), (2, None, "x"), (None, "a plain text", None), (None, None, None), (3, "", "y"), (4, "w " * 50_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'v' as toxicity", "'w' as label", "1 as score", "array(1) as kept")
    after = toxicity.keep_clean(frame, model)
    assert after.schema == frame.schema
    assert sorted(map(repr, after.collect())) == sorted(map(repr, frame.collect()))
    assert toxicity.keep_clean(frame.limit(0), model).count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}


def test_stages_take_rows_of_any_kind(spark, sf_dir):
    """Null ids and texts, repeated rows, clashing names, empty tables: each stage after the other."""
    rows = [(1, "a plain text", "x"), (1, "a plain text", "x"), (2, None, "x"), (None, "a plain text", "x"), (None, None, None), (3, "", "y"), (4, "another text altogether here", "z"), (5, "w " * 50_000, "z")]
    schema = "doc_id long, text string, source string"
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "'v' as __id", "'v' as label", "1 as kept", "2 as fp", "3 as __salt", "4 as hot")
    for start in (frame, frame.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[1:]:
            after = stage(spark, docs, sf_dir)
            if name != "sentencepiece":
                assert after.columns == docs.columns, name
            docs = corpus_pipeline.materialise(after, name)
        got = docs.collect()
        assert all(r.round_trip for r in got) and (len(got) > 0) == (start is frame)
    first = exact_dedup.keep_first(frame)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in first.collect()) == [(1, "a plain text"), (3, ""), (4, "another text altogether here"), (5, "w " * 50_000)]
