"""The pipeline against the brute-force steps it consists of."""

import corpus_pipeline
import pytest
from test_operators import brute_classes, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "packing"]
    one = stages["language_id"](spark, docs, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    assert {i for i, _ in rows} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    two = stages["near_dedup"](spark, one, SF)
    classes = brute_classes(rows)
    left = sorted((r["doc_id"], r["text"]) for r in two.collect())
    assert left == [(i, t) for i, t in rows if classes[i] == i]
    three = stages["substring_dedup"](spark, two, SF)
    want = {i: (t if not gone else kept) for (i, t), (n, gone, kept) in zip(left, (brute_repeats(left, 50)[i] for i, _ in left)) if not (gone and gone == n)}
    found = three.collect()
    assert {r["doc_id"]: r["text"] for r in found} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert one.columns == two.columns == three.columns == docs.columns
    total = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in total} == set(want) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in total)


def test_pipeline_of_odd_documents(spark):
    rows = [(1, "one two three", "en", "s", 13), (2, None, None, None, None), (None, "a text without an id", "en", "s", 20), (3, "", "en", "s", 0), (4, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        out = data
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        assert {r["doc_id"] for r in out.collect()} == ({1, None} if data is docs else set())


def test_stages_with_clashing_columns(spark):
    extra = {"sig": 1, "spans": "s", "kept": "k", "n_words": 2, "n_removed": 3, "row": "r", "all": 4, "label": "x", "class_id": 5, "draw": 6, "to__": 7, "sequence": "q", "whole__": "w", "a.b": 8, "part": 9, "ids": "i", "score": 0}
    words = [f"w{i}" for i in range(70)]
    texts = [" ".join(words), "x y " + " ".join(words[:55]) + " z" * 60, None, "", "one two three", " ".join(words) + " end"]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` {'string' if isinstance(v, str) else 'int'}" for c, v in extra.items())
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), *extra.values()) for i, t in enumerate(texts)], schema)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
    found = {r["doc_id"]: r for r in out.collect()}
    assert set(found) == {0, 1, 4} and found[1]["text"] == "x y" + " z" * 60 and found[1]["n_chars"] == 123
    assert all(tuple(r)[4:] == tuple(extra.values()) for r in found.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert {r["doc_id"] for r in packed.collect()} == {0, 1, 4}


def test_texts_stay_where_no_language_can_be_learned(spark):
    rows = [(1, "one two three"), (2, None), (3, "12 34"), (4, "four five")]
    for lang in (None, "en"):
        docs = spark.createDataFrame([(i, t, lang) for i, t in rows], "doc_id long, text string, lang string")
        out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
        assert {r["doc_id"] for r in out.collect()} == {1, 4}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_names_are_distinct(name):
    assert [n for n, _ in corpus_pipeline.STAGES].count(name) == 1
