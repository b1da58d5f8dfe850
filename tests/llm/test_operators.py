"""Each operator against a brute-force version, a library or an exact round trip, and on odd tables."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pointmill.llm import ann, cells, langid, licences, neardup, packing, pieces, repeats, rolling, urls, versions, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
LETTERS = " ▁ab\n\t\x00\x1cé\u0301ﬁ１漢🙂'sΣς\xa0|ÉİǅÀ²½x.,_"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of many kinds: nulls, empty ones, repeats, near copies, long ones."""
    words = ["".join(RNG.choices("abcdefgh", k=RNG.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(RNG.choices(words, k=RNG.randint(1, 150))) + RNG.choice(["", ".\nNext line.", "\n\nA b. C d"]) for _ in range(40)]
    texts += texts[:4] + [None, "", " ", "\n", "123 456", "x" * 5000, "word " * 3000]
    long = RNG.choices(words, k=200)
    texts += [" ".join(long), " ".join(w if i % 40 else "changed" for i, w in enumerate(long)), " ".join(["other"] * 30 + long[60:140])]
    texts += ["".join(RNG.choices(LETTERS, k=RNG.randint(0, 40))) for _ in range(20)]
    rows = [(i * 3, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def odd(spark):
    """An empty table, and one whose columns clash with names used inside."""
    none = spark.createDataFrame([], DOCS)
    clash = "doc_id long, text string, part int, ids string, sig long, draw long, spans string, bucket int, late int, next_text string, key long, cell int, label string, word string, n int"
    return none, spark.createDataFrame([(1, "one two three", 1, "i", 2, 3, "s", 4, 5, "n", 6, 7, "l", "w", 8), (None, None, 1, "i", 2, 3, "s", 4, 5, "n", 6, 7, "l", "w", 8), (1, "one two three", 1, "i", 2, 3, "s", 4, 5, "n", 6, 7, "l", "w", 8)], clash)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Word hashes and sketches


def test_words_and_runs_depend_on_the_text_alone():
    texts = [b"one two  three", b"", b" two three one ", b"one two"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    own = rolling.words(data, offsets)
    assert np.diff(own.bounds).tolist() == [3, 0, 3, 2]
    assert own.hashes[0] == own.hashes[5] == own.hashes[6] and own.hashes[1] == own.hashes[3]
    runs = own.runs(2)
    assert runs[0] == runs[6] and own.within(2).tolist() == [0, 1, 3, 4, 6]


def test_smallest_of_spans():
    values = np.random.default_rng(1).integers(0, 1000, 100).astype(np.uint64)
    for span in (1, 2, 7, 26, 100, 101):
        assert rolling.smallest(values, span).tolist() == [values[i : i + span].min() for i in range(max(0, 101 - span))]


def test_filter_never_underestimates(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64)
    rows = [r for half in (keys[:2500], keys[1500:]) for r in cells.sent(np.unique(half), 16)]
    found = cells.merged(spark.createDataFrame(rows, cells.SENT), 16)
    assert found.passes(keys[1500:2500]).all()
    assert found.passes(keys[:1500]).mean() < 0.2
    assert not cells.merged(spark.createDataFrame([], cells.SENT), 16).passes(keys).any()


# 1 Multi-index


def test_pairs_come_by_descending_sum_less_need():
    one, two = np.random.default_rng(3).random((2, 9))
    needs = np.array([0.3, 0.0, 2.0])
    order = list(ann.pairs_in_order(one, two, needs))
    sums = [one[a] + two[b] - needs[k] for k, a, b in order]
    assert len(set(order)) == 243 and sums == sorted(sums, reverse=True)


def test_layout_holds_every_cell_in_blocks_of_bounded_size():
    counts = np.random.default_rng(1).integers(0, 9, 200)
    counts[[7, 90]] = 45, 21
    own = ann.laid_out(counts, 10)
    for cell in np.flatnonzero(counts):
        for block in range(own.first_block[cell], own.first_block[cell] + own.parts[cell]):
            assert own.ranges[block][0] <= cell < own.ranges[block][1]
    sizes = [counts[slice(*r)].sum() for r, first in zip(own.ranges, range(len(own.ranges))) if own.parts[r[0]] == 1 and r[1] > r[0]]
    assert max(sizes) < 20 and own.parts[7] == 5 and own.parts[90] == 3
    split = [c for c in np.flatnonzero(own.parts > 1)]
    blocks = [b for c in split for b in range(own.first_block[c], own.first_block[c] + own.parts[c])]
    assert len(set(blocks)) == 8 and not set(blocks) & set(own.first_block[own.parts == 1])


def exact(rows, top):
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def test_search_is_exact_when_all_is_visited_and_handles_copies(spark):
    rng = np.random.default_rng(4)
    rows = {i: rng.integers(-3, 4, 8).astype(float) for i in range(150)}
    rows |= {i: rows[0] for i in range(40, 90)}
    rows = {i: v for i, v in rows.items() if v.any()}
    table = [(i, v.tolist(), 1) for i, v in rows.items()] + [(200, None, 1), (220, [0.0] * 8, 1), (240, [float("nan")] * 8, 1), (260, [1.0], 1), (280, [None] * 8, 1), (None, [1.0] * 8, 1), (1, rows[1].tolist(), 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, cell int")
    found = defaultdict(list)
    for r in ann.searched(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(found) == exact(rows, 20)
    assert ann.searched(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.searched(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_an_id_with_two_vectors_is_two_entries(spark):
    table = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (20, [1.0, 0.5]), (40, [1.0, 0.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    found = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.searched(df, F.col("vec_id") == 20, 20).orderBy("rank").collect()]
    assert found == [(20, 5, 1.0), (20, 40, 1.0), (20, 5, 0.5)]


def clouds():
    rng = np.random.default_rng(5)
    plain, centres = rng.normal(size=(6000, 48)), rng.normal(size=(150, 48))
    yield "gaussian", plain, 0.5
    yield "lengths", plain * np.exp(rng.normal(size=(6000, 1))), 0.2
    yield "clusters", centres[rng.integers(0, 150, 6000)] + 0.3 * plain, 0.2


@pytest.mark.parametrize(("name", "rows", "most"), list(clouds()), ids=lambda x: x if isinstance(x, str) else "")
def test_recall_and_share_visited(spark, name, rows, most):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").cache()
    found = defaultdict(set)
    for r in ann.searched(df, F.col("vec_id") % 40 == 0, 20).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q, near in found.items():
        scores = rows @ rows[q]
        scores[q] = -np.inf
        hits += len(near & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 150 and hits / (20 * len(found)) >= 0.9
    visits = ann.searched(df, F.col("vec_id") % 40 == 0, 20, visits=True).agg(F.avg(F.col("visited") / F.col("indexed"))).head()[0]
    assert visits < most


# 2 Language


def test_language_held_out_accuracy(spark):
    from pointmill.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op2_language_id(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert rows and sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_backoff_prefers_known_words_then_shorter_grams():
    model = langid.Backoff({"aa": {"the": 50, "thing": 5}, "bb": {"der": 50, "ding": 5}})
    assert model.predict("the")[0] == "aa" and model.predict("DER der")[0] == "bb"
    assert model.predict("things")[0] == "aa" and model.predict("derding")[0] == "bb"
    assert model.predict(None) == model.predict("") == model.predict("12 + ²") == ("und", 0.0)
    assert model.predict("漢字") == ("aa", 0.5)
    assert langid.Backoff({}).predict("word") == ("und", 0.0)


def plain_prediction(counts, text):
    """The same scores from the definition, one probability at a time."""
    import math

    langs = sorted(counts)
    marked = {lang: [(f"^{w}$", c) for w, c in counts[lang].items()] for lang in langs}
    grams = {lang: [Counter(), Counter(), Counter(), Counter()] for lang in langs}
    for lang in langs:
        for word, c in marked[lang]:
            for size in range(1, 5):
                for i in range(len(word) - size + 1):
                    grams[lang][size - 1][word[i : i + size]] += c

    def logs(tables, key):
        keys = set().union(*tables)
        if key not in keys:
            return None
        return [math.log((t.get(key, 0) + 0.5) / (sum(t.values()) + len(keys) / 2)) for t in tables]

    def gram(g):
        if g in "^$":
            return [0.0] * len(langs)
        own = logs([grams[x][len(g) - 1] for x in langs], g)
        if own is not None:
            return own
        return [0.0] * len(langs) if len(g) == 1 else [(a + b) / 2 for a, b in zip(gram(g[:-1]), gram(g[1:]))]

    total = [0.0] * len(langs)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        own = logs([counts[x] for x in langs], word)
        if own is None:
            edge, n = f"^{word}$", min(4, len(word) + 2)
            each = [gram(edge[i : i + n]) for i in range(len(edge) - n + 1)]
            own = [sum(x) / len(each) for x in zip(*each)]
        total = [t + x - max(own) for t, x in zip(total, own)]
    best = total.index(max(total))
    return langs[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_backoff_against_its_definition():
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    counts = {lang: {word(letters): rng.randint(1, 30) for _ in range(40)} for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "aeghé"))}
    model = langid.Backoff(counts)
    known = [w for c in counts.values() for w in c]
    for _ in range(200):
        text = " ".join(rng.choice(known) if rng.random() < 0.5 else word("abcdefghéx") for _ in range(rng.randint(1, 12)))
        lang, score = plain_prediction(counts, text)
        assert model.predict(text) == (lang, pytest.approx(score))


def test_language_tables(spark, docs):
    model = langid.fitted(docs, max_docs=20)
    assert model.langs == ["de", "en"]
    assert langid.identified(docs, model).count() == docs.count()
    none, clash = odd(spark)
    assert langid.identified(none, langid.fitted(none)).count() == 0
    assert [r["lang_pred"] for r in langid.identified(clash, langid.Backoff({})).collect()] == ["und"] * 3
    kept = langid.kept(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null or text = '123 456'").count() == 0


# 3 Lookup sketches


def paragraphs(text):
    import xxhash

    out = []
    for piece in re.split("[\n\r\u2028\u2029]+|(?<=[.!?])[ \t\x0b\x0c]+(?=[A-Ha-h0-9\"'(]|[^\x00-\x7f])|(?<=[\u3002\uff01\uff1f\u061f\u0964])[ \t\x0b\x0c]*", text):
        parts = [piece]
        if len(piece) > 600:
            marked = ["\x01" * (xxhash.xxh64_intdigest(w.encode(), 42) % 16 == 0) + w for w in re.split(r"[ \t\x0b\x0c]+", piece)]
            parts = " ".join(marked).split("\x01")
        for part in parts:
            out += [part[i : i + 1000] for i in range(0, len(part), 1000)] if len(part) > 4000 else [part]
    return {x for x in out if x}


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_sketches_against_sets(spark, docs):
    found = by_id(versions.fingerprinted(docs))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(paragraphs(text), paragraphs(edited)))
        assert r["near_next"] == pytest.approx(likeness(paragraphs(text), paragraphs(after)))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_sketches_of_odd_tables(spark):
    none, clash = odd(spark)
    assert versions.fingerprinted(none).count() == 0
    rows = versions.fingerprinted(clash).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (1, 13), (1, 13)]


def edited_by_brute_force(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(ordered):
        cut = len(text) // 3
        out[i] = hashlib.sha256((text[: len(text) - cut] + ordered[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest()
    return out


def test_next_documents_of_far_ids(spark, monkeypatch):
    monkeypatch.setattr(versions, "PER_BUCKET", 1)
    monkeypatch.setattr(versions, "RANGES", 4)
    near = [(i * i, f"text {i} " * (i % 7)) for i in range(200)]
    for ids in ([-(2**63), 2**63 - 1], [2**63 - 1, 2**63 - 2], [-(2**63)], [10**15]):
        rows = near + [(i, f"far {i}") for i in ids]
        found = versions.with_edited(spark.createDataFrame(rows, "doc_id long, text string"))[0].where("late = 0")
        assert {r["doc_id"]: hashlib.sha256(r["edited"].encode()).hexdigest() for r in found.collect()} == edited_by_brute_force(rows)


def test_next_documents_without_ids(spark, monkeypatch):
    monkeypatch.setattr(versions, "PER_BUCKET", 1)
    monkeypatch.setattr(versions, "RANGES", 4)
    rows = [(None, f"unnamed {i} " + "x" * i) for i in range(60)] + [(7, "seven seven"), (9, "nine nine nine")] + [(None, "unnamed 3 xxx")]
    found = versions.with_edited(spark.createDataFrame(rows, "doc_id long, text string"))[0].where("late = 0").collect()
    texts = {t for _, t in rows}
    edited = {a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a in texts for b in texts}
    assert len(found) == 63 and all(r["edited"] in edited for r in found)
    assert {r["doc_id"]: r["edited"] for r in found}[9] == "nine nine seve"
    after = [r["next_text"] for r in found]
    assert sorted(after) == sorted(t for _, t in rows)


@pytest.mark.parametrize(("retries", "per_table"), [(2, 7), (0, 60), (1, 25)])
def test_likeness_counts_every_difference(spark, monkeypatch, retries, per_table):
    monkeypatch.setattr(versions, "RETRIES", retries)
    monkeypatch.setattr(versions, "PER_TABLE", per_table)
    rng = random.Random(4)
    rows = []
    for i in range(12):
        lines = [f"line {rng.randrange(3 * 4**i // 100 + 20)}" for _ in range(rng.choice((3, 30, 300, 1500)))]
        rows.append((i, "\n".join(lines)))
    found = by_id(versions.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        after = dict(rows)[(i - 1) % 12]
        cut = len(text) // 3
        assert found[i]["near_next"] == pytest.approx(likeness(paragraphs(text), paragraphs(after)))
        assert found[i]["near_edited"] == pytest.approx(likeness(paragraphs(text), paragraphs(text[: len(text) - cut] + after[:cut])))


def test_texts_of_many_lines(spark):
    import time

    rows = [(i, "\n".join(f"line {i if j % 3 else 0} number {j}" for j in range(n))) for i, n in enumerate((16_000, 100_000))]
    began = time.perf_counter()
    found = by_id(versions.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[0]["near_next"] == pytest.approx(likeness(*(paragraphs(t) for _, t in rows)))
    assert time.perf_counter() - began < 120


def test_paragraphs_of_any_script_and_case(spark):
    texts = ["one sentence here. and another one! but a third", "Это предложение. Второе предложение. Третье.", "漢字の文。次の文。", "word " * 900, "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: {x for x in r["p"]} for r in df.select("doc_id", versions.pieces(F.col("text")).alias("p")).collect()}
    assert found == {i: paragraphs(t) for i, t in enumerate(texts)}
    assert [len(found[i]) for i in (0, 1, 2)] == [3, 3, 2] and len(found[4]) == 1


# 4 Packing


def test_packing_rebuilds_every_document(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pieces_of, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, path, window=100).collect():
        pieces_of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces_of[r["doc_id"]], key=lambda p: p["start"]):
            own = np.array(ids[at : at + p["length"]], "<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(own.tobytes()))
            at += p["length"]
        assert at == len(ids)
    for k, spans in sequences.items():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends == 100 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_word_table_equals_the_tokenizer():
    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    own.words.kept = own.parts.kept = 50
    texts = ["".join(RNG.choices([*LETTERS, "<|endoftext|>", "word", "don't"], k=RNG.randint(0, 15))) for _ in range(3000)]
    for a in range(0, 3000, 500):
        some = texts[a : a + 500]
        full = own.tokenizer.encode_batch(some, add_special_tokens=False)
        assert [np.array(f.ids, own.kind).tobytes() for f in full] == own.encode(some)


def test_packing_odd_tables(spark):
    none, clash = odd(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.packed(none, path).count() == 0
    assert sorted(r["doc_tokens"] for r in packing.packed(clash, path).collect()) == [1, 4, 4]


# 5 Licenses


def brute_phrases(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_licence_phrases_and_notices(spark, docs):
    extra = ["The MIT License. the mit  license", "GNU General Public Licence v3", "mit license apache license CC-BY", "permision is hereby granted, free of charge, to any persn", "é license mit", "Licensed under the Apache Lisence"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    found = by_id(licences.scanned(df))
    for r in df.collect():
        own = found[r["doc_id"]]
        n, places = brute_phrases(r["text"])
        assert own["n_words"] == n and [(x["word"], x["label"]) for x in own["base"]] == places
        for x in own["found"]:
            line = licences.normalised(r["text"])[1][1:]
            assert x["edits"] <= 5 and line[: x["begin"]].count(" ") == x["first_word"]
    assert {x["label"] for x in found[1001]["found"]} == {"gpl"} and not found[1001]["base"]
    assert [(x["label"], x["edits"]) for x in found[1003]["found"]] == [("mit", 2)]
    assert {x["label"] for x in found[1005]["found"]} == {"apache"}
    none, clash = odd(spark)
    assert licences.scanned(none).count() == 0 and licences.scanned(clash).count() == 3


def test_every_notice_within_its_edits_is_found():
    scan = licences.Scanner(licences.PHRASES, licences.NOTICES)
    for notice in licences.NOTICES:
        for _ in range(30):
            changed = list(notice.words)
            for _ in range(notice.edits):
                changed[RNG.randrange(1, len(changed) - 1)] = RNG.choice("qz")
            line = f" foo {''.join(changed)} bar "
            assert notice.label in {x["label"] for x in scan.fuzzy(line)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def runs_within(line, notice):
    """Every run of words within the notice's edits: begin, end and edits."""
    ends = [0]
    for word in line.split():
        ends.append(ends[-1] + len(word) + 1)
    for i, begin in enumerate(ends):
        for end in (e - 1 for e in ends[i + 1 :]):
            if abs(end - begin - len(notice.words)) <= notice.edits:
                d = edit_distance(line[1:][begin:end], notice.words)
                if d <= notice.edits:
                    yield begin, end, d


def edited(text, edits):
    out = list(text)
    for _ in range(edits):
        i, kind = RNG.randrange(1, len(out) - 1), RNG.randrange(3)
        out[i : i + (kind < 2)] = RNG.choice("abz ") if kind else ""
    return "".join(out)


def test_spans_of_several_notices_against_edit_distance():
    some = [n for n in licences.NOTICES if len(n.words) < 40]
    scan = licences.Scanner(licences.PHRASES, tuple(some))
    for _ in range(60):
        parts = []
        for _ in range(RNG.randint(1, 4)):
            notice = RNG.choice(some)
            parts += [edited(notice.words, RNG.randint(0, notice.edits + 1)), RNG.choice(["", "", "gnu", "public license bar"])]
        line = f" {' '.join(' '.join(parts).split())} "
        found = scan.fuzzy(line)
        for notice in some:
            mine = [(x["begin"], x["end"], x["edits"]) for x in found if x["label"] == notice.label and x["of"] == len(notice.words)]
            assert all(edit_distance(line[1:][b:e], notice.words) == d for b, e, d in mine)
            assert all(e <= b for (_, e, _), (b, _, _) in zip(sorted(mine), sorted(mine)[1:]))
            for begin, end, d in runs_within(line, notice):
                assert any(b < end and begin < e and z <= d for b, e, z in mine)


def test_a_worse_notice_before_a_better_one_is_reported():
    scan = licences.Scanner(licences.PHRASES, licences.NOTICES)
    found = scan.fuzzy(" mozilla public licens mozilla public license ")
    assert [(x["first_word"], x["n_words"], x["edits"]) for x in found] == [(0, 3, 1), (3, 3, 0)]


def test_licences_of_a_very_long_text(spark):
    text = "lorem ipsum license " * 200_000 + "released under teh mit license " + "x" * 10**6
    found = licences.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert found["n_words"] == 600_006 and [x["word"] for x in found["base"]] == [600_003]
    assert {(x["label"], x["first_word"], x["edits"]) for x in found["found"]} == {("mit", 600_000, 2)}


# 6 Substrings


def brute_repeats(rows, window):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in sorted(rows)]
    for i, w in split:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out[i] = (len(w), keep.count(False), " ".join(x for x, y in zip(w, keep) if y))
    return out


@pytest.mark.parametrize("window", [50, 7, 2])
def test_repeats_against_brute_force(spark, docs, window):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(docs, window).collect()}
    assert found == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], window)


def test_repeats_of_many_overlapping_passages(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        a = rng.randrange(0, 240)
        rows.append((rng.randrange(10**6) * 100 + i, " ".join([f"x{i}"] * rng.randrange(5) + base[a : a + rng.randrange(5, 60)] + [f"y{i}"] + base[: rng.randrange(0, 40)])))
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    assert found == brute_repeats(rows, 10)


def test_repeats_of_odd_tables(spark):
    none, clash = odd(spark)
    assert repeats.without_repeats(none).count() == 0
    assert sorted(r["n_removed"] for r in repeats.without_repeats(clash, 2).collect()) == [0, 0, 0]
    same = spark.createDataFrame([(5, "a b c"), (5, "z a b c"), (6, "a b c d"), (None, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.without_repeats(same, 3).collect()) == [(0, 0), (5, 0), (5, 0), (6, 3)]


CLASHES = "doc_id long, text string, row string, `all` int, kept string, n_words int, n_removed int, spans string, sig long, `a.b` int, label string, draw long, class_id long, n_chars int"


def test_trimming_with_clashing_columns(spark):
    words = [f"w{i}" for i in range(80)]
    texts = {1: " ".join(words), 2: "z " + " ".join(words[:60]) + "  y", 3: " ".join(words[:50]), 4: None, 5: "  a  b "}
    rows = [(i, t, "r", 1, "k", 2, 3, "s", 4, 5, "l", 6, 7, 99) for i, t in texts.items()]
    df = spark.createDataFrame(rows, CLASHES)
    out = repeats.trimmed(df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    found = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in found.items()} == {1: texts[1], 2: "z y", 4: None, 5: "  a  b "}
    assert [found[i]["n_chars"] for i in (1, 2)] == [99, 3] and tuple(found[2])[2:13] == ("r", 1, "k", 2, 3, "s", 4, 5, "l", 6, 7)
    assert repeats.trimmed(df.select("text")[df["text"].isNull()].withColumn("doc_id", F.lit(1))).count() == 1


@pytest.mark.parametrize("hot", [2, 512])
def test_repeats_of_one_hot_passage(spark, monkeypatch, hot):
    from pointmill.plans import joins

    monkeypatch.setattr(joins, "HOT", hot)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{common} u{i} " * (1 + i % 3) + f"t{i % 5} " * 12) for i in range(80)]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    assert found == brute_repeats(rows, 10)


def test_substring_query_matches_sql(spark):
    import duckdb

    from pointmill.llm.oracle import ORACLE
    from pointmill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine = QUERIES["op6_substring_dedup"](spark, sf).toPandas()
    other = con.execute(ORACLE["op6_substring_dedup"]).fetchdf()[list(mine.columns)]
    assert sorted(map(tuple, mine.values.tolist())) == sorted(map(tuple, other.values.tolist()))


# 7 Near duplicates


def plain_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    m = row[-1]
    return m / (len(a) + len(b) - m)


def test_alignment_against_plain_dynamic_programming():
    for _ in range(1500):
        a, b = (np.array(RNG.choices(range(6), k=RNG.randint(1, 16)), np.uint64) for _ in range(2))
        full = plain_similarity(a.tolist(), b.tolist())
        for least in (0.8, 0.5, 0.3):
            assert neardup.aligned(a, b, least) == pytest.approx(full if full >= least - 1e-9 else 0)


def brute_classes(rows, least=0.8):
    column = pa.array([t for _, t in rows], pa.string())
    own = [w for w, *_ in neardup.sequences_of(column, 5)]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(rows)):
        for k in range(j):
            if len(own[j]) and len(own[k]) and neardup.aligned(own[k], own[j], least) >= least:
                a, b = sorted((root(rows[k][0]), root(rows[j][0])))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def test_classes_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for i in range(30):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.choice((1, 1, 2, 4))):
            copy = [rng.choice(vocabulary) if rng.random() < 0.03 else w for w in base]
            rows.append((len(rows) * 7, " ".join(copy)))
    rows += [(5000 + i, t) for i, t in enumerate([None, "", "...", "one two", "One, two!", rows[0][1]])]
    rng.shuffle(rows)
    rows.sort()
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)
    assert found[5005] == 0 and found[5004] == 5003 and found[5000] == 5000


def test_crowded_buckets_still_join_copies_of_a_common_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWDED", 4)
    monkeypatch.setattr(neardup, "STRAYS", 1)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}x{j}" for j in range(3 * i)])) for i in range(20)]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)


@pytest.mark.parametrize("part", [1024, 16])
def test_crowded_copies_that_one_original_holds_together(spark, monkeypatch, part):
    for name, value in (("CROWDED", 2), ("STRAYS", 0), ("PART", part)):
        monkeypatch.setattr(neardup, name, value, raising=False)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(70, " ".join(base))]
    for i in range(60):
        gone = set(rng.sample(range(300), 24))
        rows.append((i, " ".join(f"c{i}x{k}" if k in gone else w for k, w in enumerate(base))))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(sorted(rows)) == dict.fromkeys(found, 0)


def test_pairs_in_a_crowd_that_shares_a_passage(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    passage, rows = rng.choices(vocabulary, k=300), []
    for _ in range(60):
        rest = rng.choices(vocabulary, k=100)
        other = [rng.choice(vocabulary) if k % 5 == 0 else w for k, w in enumerate(rest)]
        rows += [(len(rows), " ".join(passage + rest)), (len(rows) + 1, " ".join(passage + other))]
    found = {r["doc_id"]: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == {i: i // 2 * 2 for i in range(120)}
    assert all(r["n_links"] >= 1 for r in found.values())


def test_links_are_true_and_connect_the_classes(spark):
    rng = random.Random(13)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(6, 80))]
        for _ in range(rng.choice((1, 2, 5))):
            rows.append((len(rows), " ".join(w if rng.random() > 0.04 else "new" for w in base)))
    rows += [(1000 + i, t) for i, t in rows[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, links = neardup.near_duplicates(df, 0.8, 5, 40, 2, 11, "doc_id", "text")
    of, texts = {r["doc_id"]: r for r in found.collect()}, dict(rows)
    pairs = {(r["src"], r["dst"]) for r in links.collect()}
    assert pairs and all(a < b and plain_similarity(texts[a].split(), texts[b].split()) >= 0.8 for a, b in pairs)
    root = {i: min(j for j, t in rows if t == texts[i]) for i, _ in rows}
    degree = Counter(x for p in pairs for x in p)
    assert all(of[i]["n_links"] == degree[root[i]] for i, _ in rows)
    group = {i: root[i] for i in root}
    for _ in rows:
        for a, b in pairs:
            low = min(group[a], group[b])
            group = {i: low if g in (group[a], group[b]) else g for i, g in group.items()}
    assert {i: r["class_id"] for i, r in of.items()} == group


def test_one_changed_word_in_a_short_text(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(150):
        words = [f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(500)}" for _ in range(10 + i % 15)]
        other = list(words)
        other[len(words) // 2] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rows += [(900, "one two three four"), (901, "one two three four five")]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = sum(found[2 * i + 1] != 2 * i for i in range(150))
    assert missed <= 1 and found[901] == 900


def test_links_of_a_block_against_all_pairs():
    rng = random.Random(9)
    sequences = []
    for _ in range(12):
        base = rng.choices(range(500), k=rng.randint(5, 60))
        sequences += [np.array([rng.randrange(500) if rng.random() < 0.08 else w for w in base], "<u4") for _ in range(5)]
    linked = lambda i, j: neardup.aligned(sequences[i], sequences[j], 0.8) >= 0.8
    for split in (60, 23):
        first = np.arange(60) < split
        pairs = [(i, j) for i in range(60) for j in range(i) if (split == 60 or first[i] != first[j]) and linked(i, j)]
        own = np.arange(60)
        got = neardup.block_links(first, own, sequences, 0.8)

        def parts(edges):
            root = list(range(60))
            for a, b in edges:
                root = [root[a] if x == root[b] else x for x in root]
            return {frozenset(k for k in range(60) if root[k] == x) for x in root}

        assert parts(got) == parts(pairs) and len(got) == 60 - len(parts(pairs))


def test_classes_of_odd_tables(spark):
    none, clash = odd(spark)
    assert neardup.classes(none).count() == 0
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in neardup.classes(clash).collect()) == [(0, 0), (1, 1), (1, 1)]


# 8 SentencePiece


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, digests = by_id(pieces.round_trip(docs, path)), by_id(pieces.round_trip(docs, path, digests=True))
    for r in docs.collect():
        ids = model.encode(r["text"] or "")
        own = plain[r["doc_id"]]
        assert (own["n_tokens"], own["ids"], own["decoded"]) == (len(ids), ",".join(map(str, ids)), model.decode(ids))
        assert digests[r["doc_id"]]["ids"] == hashlib.sha256(own["ids"].encode()).hexdigest()


@pytest.mark.parametrize("chars", [1, 3000])
def test_runs_of_any_size_equal_the_library(spark, monkeypatch, chars):
    import sentencepiece

    monkeypatch.setattr(pieces, "RUN_CHARS", chars)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = 300 if chars == 1 else 3000
    texts = ["".join(RNG.choices([*LETTERS, "<s>", "word", "  "], k=RNG.randint(0, 15))) for _ in range(n)] + [None, "", "y" * 50_000, "a b " * 9000]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)]
    found = pieces.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path).collect()
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        want.append((-1 if i is None else i, len(ids), ",".join(map(str, ids)), model.decode(ids)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in found) == sorted(want)


def test_runs_list_each_word_once_and_by_bucket():
    rows = [(i, f"common word{i % 7} common") for i in range(60)]
    lists = [r for a in (0, 30) for r in coded_run(a, rows[a : a + 30]).to_pylist()]
    words = sorted(w for r in lists if r["bucket"] >= 0 for w in pieces.unpacked(r["packed"], r["size"]))
    assert words == sorted(2 * ["common", *(f"word{i}" for i in range(7))])
    assert {pieces.zlib.crc32(w.encode()) % 4 for w in words} == {r["bucket"] for r in lists} - {-1}


def test_pieces_take_one_shuffle_there_and_one_back(spark):
    from pathlib import Path

    from pointmill.plans.scratch import shared_dir

    kept = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("pointmill-*"))
    before, docs = kept(), spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    found = pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert (final.count("+- Exchange "), final.count("ReusedExchange"), kept() - before) == (2, 1, set())


def test_texts_that_differ_between_two_readings_are_refused(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        steady = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
        assert sorted(r["decoded"] for r in pieces.round_trip(steady, path).collect()) == sorted(f"word {i}" for i in range(20))
        changing = F.udf(lambda i: f"word {random.SystemRandom().random()}", "string").asNondeterministic()
        with pytest.raises(Exception, match="the texts changed"):
            pieces.round_trip(steady.select("doc_id", changing("doc_id").alias("text")), path).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def coded_run(number, rows):
    own = pieces.Run(number)
    for i, text in rows:
        own.add(i, text)
    return own.rows(4)


def test_pieces_of_odd_tables(spark):
    none, clash = odd(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.round_trip(none, path).count() == 0
    assert sorted(r["decoded"] for r in pieces.round_trip(clash, path).collect()) == ["", "one two three", "one two three"]


# 9 WARC

PAGES = "page_id long, url string, html string, archive string, sha string, refers_to long"


def page_rows():
    big = "long " * 100_000
    htmls = ["<p>a</p>", None, "<p>a</p>", "", "é\r\n\r\nWARC/1.1\r\n", big, "<p>a</p>", big, "\x00"]
    return [(i, f"http://e.org/{i}?q=é\n", h, "x", "y", 1) for i, h in enumerate(htmls)] + [(None, None, "<p>a</p>", "x", "y", 1)]


def test_warc_round_trip(spark):
    rows = page_rows()
    index = warc.archived(spark.createDataFrame(rows, PAGES).repartition(3))
    found = sorted(warc.read_back(index).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    first = {}
    for r in rows[:-1]:
        first.setdefault(r[2] or "", r[0])
    for r, (page, _, html, *_) in zip(found, rows):
        body = (html or "").encode()
        origin = first[html or ""] if page is not None else None
        same = page is None or origin == page
        assert (r["page_id"], r["payload_bytes"], r["payload_digest"]) == (page, len(body), warc.digest(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if same else ("revisit", origin))
    places = index.orderBy("archive", "offset").collect()
    for name in {p["archive"] for p in places}:
        content = open(name.removeprefix("file://"), "rb").read()
        own = [p for p in places if p["archive"] == name]
        assert own[0]["offset"] == 0 and sum(p["length"] for p in own) == len(content)
        assert len(list(warc.records(warc.inflated(io.BytesIO(content))))) == len(own)


def test_normalising_a_monolith_and_broken_streams():
    sink = io.BytesIO()
    mono = warc.Monolith(sink)
    made = [warc.page_record(i, "http://a", b"body" * i, warc.digest(b"body" * i), 4 * i, None) for i in range(5)]
    for r in made:
        mono.add(r)
    mono.close()
    out = io.BytesIO()
    places = list(warc.normalise(io.BytesIO(sink.getvalue()), out))
    assert [r.block for _, _, r in places] == [r.block for r in made]
    for offset, length, r in places:
        ((_, own),) = warc.records(warc.inflated(io.BytesIO(out.getvalue()[offset : offset + length])))
        assert own == r
    with pytest.raises(ValueError):
        list(warc.records([warc.serialised(made[1])[:-3]]))


def test_warc_odd_tables(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_back(warc.archived(none)).count() == 0
    small = spark.createDataFrame([(1, "u", "ab", "", "", 0), (2, "u", "ab", "", "", 0), (3, "u", "abcd", "", "", 0), (4, "u", "abcd", "", "", 0)], PAGES)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_back(warc.archived(small, min_bytes=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# 10 URLs


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_url_rules_against_brute_force(spark):
    hosts = ["WWW.Example.COM", "example.com", "a.example.com", "notexample.com", "com", "x.net", "net", "e.org", "É.org", ""]
    tails = ["", "/", "/en/", "/en", "/en/a?b=/fr/", "/es/x#y", "/fr/12", "?q=://x", "#f", "/a\nb"]
    listed = [f"http://{h}{t}" for h in hosts for t in tails] + [None, "", "no scheme/en/", "a://b://c/d", "http:/x.net/es/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(listed)], "page_id long, url string, label string")
    found = {r["page_id"]: r for r in urls.judged(df).collect()}
    for i, u in enumerate(listed):
        host, path, rule = brute_url(u)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule and rule.host + rule.path)
        assert found[i]["verdict"] in ("allow", "block") and (rule is None or found[i]["verdict"] == rule.verdict)


def brute_rules(baskets, support, confidence):
    from itertools import combinations

    n, counts, both = len(baskets), Counter(), Counter()
    for tokens, label in baskets:
        for size in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), size):
                counts[some] += 1
                both[some, label] += 1
    share = Counter(label for _, label in baskets)
    full = {(t, lab): c / counts[t] for (t, lab), c in both.items() if lab is not None and c / n >= support and c / counts[t] >= max(confidence, share[lab] / n + 1e-12) and lab != "allow"}
    return {(t, lab): v for (t, lab), v in full.items() if not any(set(o) < set(t) and lab2 == lab for o, lab2 in full)}


def test_mined_rules_against_all_combinations(spark):
    rng = random.Random(8)
    baskets = []
    for _ in range(200):
        tokens = {t for t in "abcdef" if rng.random() < 0.4}
        baskets.append((sorted(tokens), None if rng.random() < 0.2 and "c" in tokens else "block" if {"a", "b"} <= tokens or rng.random() < 0.1 else "allow"))
    df = spark.createDataFrame(baskets, "tokens array<string>, label string")
    found = {(r.tokens, r.label): r.confidence for r in urls.mined(df, 0.05, 0.8)}
    want = brute_rules(baskets, 0.05, 0.8)
    assert found.keys() == want.keys() and ("a", "b") in {t for t, _ in found}
    assert all(found[k] == pytest.approx(want[k]) for k in want)
    judged = urls.matched(spark.createDataFrame([(1, ["a", "b", "z"]), (2, ["z"]), (3, None)], "page_id long, tokens array<string>"), urls.mined(df, 0.05, 0.8))
    assert [(r["page_id"], r["label"]) for r in judged.orderBy("page_id").collect()] == [(1, "block"), (2, "allow"), (3, "allow")]


def test_a_surer_rule_of_the_default_label_wins(spark):
    known = [("http://a.x/p", "block")] * 8 + [("http://a.x/p", "allow")] * 2 + [("http://b.y/q", "allow")] * 10
    labelled = spark.createDataFrame(known, "url string, label string")
    pages = spark.createDataFrame([(1, "http://a.x/q"), (2, "http://a.x/p"), (3, "http://c.z/r")], "page_id long, url string")
    found = by_id(urls.judged(pages, (urls.Rule("none.example", "/", "block"),), 0.1, 0.8, labelled=labelled).withColumnRenamed("page_id", "doc_id"))
    assert [(found[i]["verdict"], found[i]["confidence"]) for i in (1, 2, 3)] == [("allow", 1.0), ("block", 0.8), ("allow", 0.0)]


def test_a_token_of_undecided_urls_blocks_none(spark):
    known = [f"http://a{i}.x.net/es/{i}" for i in range(20)] + [f"http://b{i}.y.com/es/{i}" for i in range(20)]
    open_ = [f"http://c{i}.z.net/en/{i}" for i in range(30)] + ["http://d.x.net/blog/es/9"]
    pages = spark.createDataFrame(list(enumerate(known + open_)), "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.judged(pages).collect()}
    assert [found[i] for i in range(40)] == ["block"] * 20 + ["allow"] * 20
    assert {found[i] for i in range(40, 70)} == {"allow"} and found[70] == "block"
    places = urls.placed(pages, urls.RULES, "page_id", "url").select("tokens", F.col("fixed").alias("label"))
    own = urls.measured(places)
    assert own.urls >= own.judged == own.right > 0


def test_support_rises_where_tokens_have_many_combinations(spark):
    rows = [([f"t{k}" for k in range(16)], "block" if i % 2 else "allow") for i in range(40)] + [([f"u{i % 3}"], "block") for i in range(60)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    baskets = df.select(F.col("tokens").alias("items"))
    assert urls.bounded_support(baskets, 0.01, 100) == 0.5 and urls.bounded_support(baskets.where("size(items) = 1"), 0.01, 60) == 0.01
    assert urls.mined(df, 0.01, 0.8, None) == []


def test_no_rule_is_lost_where_tokens_have_many_combinations(spark):
    near = [([f"t{k}" for k in range(24) if k != i], "block" if i % 2 else "allow") for i in range(40)]
    rows = [*near, *(([f"u{i % 3}"], "block") for i in range(40)), *(([f"v{i % 2}", f"w{i % 3}"], "allow" if i % 6 == 5 else None) for i in range(24)), ([], "block"), (None, None)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    found = {(r.tokens, r.label): (r.confidence, round(r.support * len(rows))) for r in urls.every_rule(df, 0.02, 0.8, None)}
    assert found == {(("u0",), "block"): (1.0, 14), (("u1",), "block"): (1.0, 13), (("u2",), "block"): (1.0, 13), (("v1", "w2"), "allow"): (1.0, 4)}


def test_crowded_urls_are_judged_by_rare_tokens(spark):
    crowd = "/".join(f"w{k}" for k in range(20))
    known = [(f"http://a{i}.x/{crowd}", "block" if i % 2 else "allow") for i in range(60)] + [(f"http://b{i}.y/bad", "block") for i in range(5)] + [(f"http://c{i}.z/good", "allow") for i in range(35)]
    labelled = spark.createDataFrame(known, "url string, label string")
    pages = spark.createDataFrame([(1, "http://d.w/bad"), (2, f"http://d.w/{crowd}")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.judged(pages, (urls.Rule("none.example", "/", "block"),), labelled=labelled).collect()}
    assert found == {1: "block", 2: "allow"}


@pytest.mark.parametrize("a_pass", [1, 1 << 17])
def test_grown_rules_equal_all_combinations(spark, monkeypatch, a_pass):
    monkeypatch.setattr(urls, "MOST_SETS", 0)
    monkeypatch.setattr(urls, "A_PASS", a_pass)
    rng = random.Random(9)
    letters = "abcd" if a_pass == 1 else "abcdefgh"
    baskets = []
    for _ in range(200):
        tokens = {t for t in letters if rng.random() < 0.5}
        label = "block" if {"a", "b", "c"} <= tokens or rng.random() < 0.2 else rng.choice(["allow", "other"]) if "d" in tokens else None
        baskets.append((sorted(tokens), label))
    df = spark.createDataFrame(baskets, "tokens array<string>, label string")
    found = {(r.tokens, r.label): r.confidence for r in urls.every_rule(df, 0.02, 0.75)}
    want = brute_rules(baskets, 0.02, 0.75)
    assert found.keys() == want.keys() and max(len(t) for t, _ in found) > 2
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_urls_without_ids_and_very_long_ones(spark):
    rows = [(None, "http://x.net/es/1"), (None, None), (3, "http://x.com/" + "a/" * 10**6), (3, "http://x.com/"), (4, "http://" + "h" * 10**6)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, tokens string, fixed string")
    found = urls.judged(df).collect()
    assert sorted((r["page_id"] or 0, len(r["path"]), r["verdict"]) for r in found) == [(0, 0, "allow"), (0, 5, "block"), (3, 1, "allow"), (3, 2 * 10**6 + 1, "allow"), (4, 0, "allow")]


def test_urls_of_an_empty_table(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
