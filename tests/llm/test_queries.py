"""The registered queries of the training-data operators on the smallest tables, against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_classes, brute_phrases, brute_url, edited_by_brute_force, exact, likeness, paragraphs

from pointmill.llm import warc
from pointmill.llm.oracle import ORACLE
from pointmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def answer(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


def test_search(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want, found = exact(rows, 20), defaultdict(list)
    for r in QUERIES["op1_multi_index"](spark, SF).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        assert r["score"] == pytest.approx(float(rows[r["query_id"]] @ rows[r["vec_id"]]), abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    assert found.keys() == want.keys() and all(len(x) == 20 for x in found.values())
    hits = sum(len({i for i, _ in want[q]} & set(found[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_fingerprints(spark, texts):
    found, want = answer(spark, "op3_lookup_sketch"), edited_by_brute_force(list(texts.items()))
    ordered = sorted(texts, reverse=True)
    for k, i in enumerate(ordered):
        after, text = texts[ordered[(k + 1) % len(ordered)]], texts[i]
        cut = len(text) // 3
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(text), want[i])
        assert found[i]["near_edited"] == pytest.approx(likeness(paragraphs(text), paragraphs(text[: len(text) - cut] + after[:cut])))
        assert found[i]["near_next"] == pytest.approx(likeness(paragraphs(text), paragraphs(after)))
    assert len({r["fingerprint"] for r in found.values()}) == len({frozenset(paragraphs(t)) for t in texts.values()})


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in QUERIES["op4_packing"](spark, SF).orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]] += r["length"]
    for i, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for p in pieces[i]:
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes()))
            at += p["length"]
        assert at == len(ids)
    assert all(n == 2048 for k, n in sequences.items() if k < max(sequences))


def test_licences(spark, texts):
    found = answer(spark, "op5_license_scan")
    for i, text in texts.items():
        n, places = brute_phrases(text)
        r = found[i]
        at = [w for w, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_classes(spark, texts):
    assert {i: r["class_id"] for i, r in answer(spark, "op7_order_minhash").items()} == brute_classes(sorted(texts.items()))


def test_pieces(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = answer(spark, "op8_sentencepiece")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in texts.items():
        ids = model.encode(text)
        assert tuple(found[i]) == (i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_archives(spark):
    pages = sorted((r["page_id"], r["html"] or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    first, want = {}, {}
    for i, html in pages:
        origin = first.setdefault(html, i)
        want[i] = (i, len(html.encode()), warc.digest(html.encode()), "response" if origin == i else "revisit", None if origin == i else origin)
    assert {i: tuple(r) for i, r in answer(spark, "op9_warc", "page_id").items()} == want


def test_urls(spark):
    found = answer(spark, "op10_url_filter", "page_id")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        host, path, rule = brute_url(r["url"])
        own = found[r["page_id"]]
        assert (own["host"], own["path"], own["rule"]) == (host, path, rule and rule.host + rule.path)
        assert own["verdict"] == rule.verdict if rule else own["verdict"] in ("allow", "block")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    import duckdb
    import pandas

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = QUERIES[name](spark, SF).toPandas()
    other = con.execute(ORACLE[name]).fetchdf()[list(mine.columns)]
    plain = lambda frame: sorted((tuple(None if pandas.isna(x) else x for x in row) for row in frame.values.tolist()), key=repr)
    assert plain(mine) == plain(other)
