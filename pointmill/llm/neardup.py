"""Near-duplicate documents by Order MinHash.

A document's words (A-Z lower-cased, cut at ASCII signs and white space) give
its sequence of shingles of five words, each labelled with its occurrence in the
document.  For each of ``draws`` random orders the ``kept`` smallest labelled
shingles are taken and hashed in the order in which they stand in the text; two
documents with an equal draw are candidates, and the chance of that falls with
edit similarity, not only with set similarity.  Documents of at most ``SHORT``
words, in which a single changed word spoils most shingles of five, are drawn
from by shingles of two words as well.

A candidate pair is verified by banded alignment of the words: the largest number
m of words that can be aligned in order, where positions i and j may meet only
within the band that an alignment of the threshold can need.  The similarity is
m / (n1 + n2 - m) for n1 and n2 words, and a link is 0.8 or more.  The README
says how many pairs at the threshold share a draw, by kind of edit.

Documents with equal word sequences are one class from the start, represented by
the smallest id.  In every bucket of equal draws, in ``PICKS`` rounds, all
members are verified against one of them, picked by a hash that differs between buckets
and rounds, in the last round the one with the fewest words; members that the
links so far connect to it are left out, so the first round looks at one bucket in
``FIRST``, which connects most copies, and the others need few pairs more.
The members still outside the bucket's largest component, its strays, are then
verified against all members in other components, so that every candidate pair
is verified or inside one component already, without all pairs of a group.

In crowded buckets (over ``CROWDED`` members, over ``STRAYS`` of them stray: a
passage that many unlike documents share, or copies that only one original holds
together) the same pairs are not written out.  Such a bucket is dealt out in
blocks of two parts of at most about ``PART`` members each; a bucket that is more
than one part is cut by length first, as documents whose lengths differ too much
can't be linked.  Within a block, pairs of one component are left out, then those
whose words, counted without their order, are too few in common for a link (an
upper bound of the alignment, so no link is lost), and the others are aligned.

Fewer than five words make one shingle of all of them.  Documents without words,
null texts included, are classes of their own; rows that share an id share its
class; rows with a null id have a null class.  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from ..plans.joins import unique_join
from ..plans.scratch import dropped, written
from . import cells
from .rolling import LOWER, SIGN, U, mixed, text_runs, words

#: Members and strays beyond which a bucket is crowded, rounds of picked members, and the part of all buckets that the first round looks at.
CROWDED, STRAYS, PICKS, FIRST = 48, 16, 3, 4
#: Words that a short text has at most, and the size and number of its further draws.
SHORT, SHORT_SIZE, SHORT_DRAWS = 24, 2, 12
#: Members and words in a part of a crowded bucket.
PART, PART_WORDS = 1024, 1 << 22
SKETCH = "doc_id long, n int, sig long, sig2 long, draws array<long>"
SEQUENCE = "doc_id long, sequence binary"


def sequences_of(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Per text the hashes of its words and its occurrence-labelled shingles, in order, and a short text's of ``SHORT_SIZE`` words."""
    for _, data, offsets in text_runs(column):
        own = words(LOWER[data], offsets, SIGN)
        runs, short_runs = own.runs(size), own.runs(SHORT_SIZE)
        for a, b in zip(own.bounds[:-1], own.bounds[1:]):
            short = labelled(short_runs[a : b - SHORT_SIZE + 1]) if SHORT_SIZE <= b - a <= SHORT else None
            if b - a < size:
                yield own.hashes[a:b], own.between(np.array([a]), np.array([b])) if b > a else runs[:0], short
            else:
                yield own.hashes[a:b], labelled(runs[a : b - size + 1]), short


def labelled(plain: np.ndarray) -> np.ndarray:
    """Shingles made different by their occurrence; a first occurrence stays as it is."""
    order = np.argsort(plain, kind="stable")
    ordered = plain[order]
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    if first.all():
        return plain
    start = np.flatnonzero(first)
    occurrence = np.arange(len(ordered)) - np.repeat(start, np.diff(np.append(start, len(ordered))))
    labels = np.empty_like(plain)
    labels[order] = np.where(first, ordered, mixed(ordered + occurrence.astype(U) * U(0x9E3779B97F4A7C15)))
    return labels


def _draws(labels: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One value for each random order."""
    kept = weights.shape[1]
    if len(labels) <= kept:
        return mixed((labels * weights[0, : len(labels)]).sum() + keys[:, 0])
    chosen = np.argpartition((labels[None, :] ^ keys) * keys, kept - 1, axis=1)[:, :kept]
    chosen.sort(axis=1)
    return mixed((labels[chosen] * weights).sum(axis=1) + keys[:, 0])


def aligned(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """Similarity of two word sequences by banded alignment; 0 where it can't reach ``least``.

    A bit of ``open_`` per word of y says whether the alignment's length does not grow there.
    """
    total = len(x) + len(y)
    need = total * least / (1 + least) - 1e-9
    if min(len(x), len(y)) < need:
        return 0.0
    short = min(len(x), len(y))
    unequal = np.flatnonzero(x[:short] != y[:short])
    front = int(unequal[0]) if len(unequal) else short
    unequal = np.flatnonzero(x[len(x) - short + front :][::-1] != y[len(y) - short + front :][::-1])
    back = int(unequal[0]) if len(unequal) else short - front
    one, two = x[front : len(x) - back].tolist(), y[front : len(y) - back].tolist()
    matches = front + back
    if one and two:
        band = int(total - 2 * need) + 1
        window, full, places = (1 << (2 * band + 1)) - 1, (1 << len(two)) - 1, {}
        for j, word in enumerate(two):
            places[word] = places.get(word, 0) | 1 << j
        open_ = full
        for i, word in enumerate(one):
            here = places.get(word)
            if here:
                met = open_ & here & (window << (i - band) if i > band else window >> (band - i))
                open_ = ((open_ + met) | (open_ - met)) & full
        matches += len(two) - open_.bit_count()
    return matches / (total - matches) if matches >= need else 0.0


def bags(sequences: list[np.ndarray]) -> np.ndarray:
    """Occurrences of words, a row for each sequence; words may share a column, which only raises what two rows have in common."""
    bits = min(12, max(9, max(map(len, sequences)).bit_length()))
    counts = np.stack([np.bincount((mixed(own.astype(U)) >> U(64 - bits)).astype(np.int64), minlength=1 << bits) for own in sequences])
    return counts.astype(np.min_scalar_type(int(counts.max())))


def block_links(first: np.ndarray, own: np.ndarray, sequences: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect the components ``own`` of a block's members, as pairs of places.

    All pairs are looked at, or with members that are not ``first`` those of a
    first with another one; a pair that the links so far connect is left out.
    """
    names, place = np.unique(own, return_inverse=True)
    if len(names) < 2:
        return []
    root = np.arange(len(names))
    n, table, found = np.array([len(x) for x in sequences]), bags(sequences), []
    others = np.flatnonzero(~first)
    for i in np.flatnonzero(first):
        to = others if len(others) else np.arange(i + 1, len(n))
        need = (n[i] + n[to]) * least / (1 + least) - 1e-9
        to = to[(root[place[to]] != root[place[i]]) & (np.minimum(n[i], n[to]) >= need)]
        need = (n[i] + n[to]) * least / (1 + least) - 1e-9
        to = to[np.minimum(table[i], table[to]).sum(axis=1, dtype=np.int64) >= need]
        for j in to.tolist():
            a, b = root[place[i]], root[place[j]]
            if a != b and aligned(sequences[i], sequences[j], least) >= least:
                root[root == b] = a
                found.append((int(i), j))
    return found


def classes(docs: DataFrame, least: float = 0.8, size: int = 5, draws: int = 40, kept: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The smallest id of each document's class: doc_id, class_id, n_links, a row for each row of ``docs``.

    ``n_links`` counts the verified links of the document's text to other texts:
    enough to connect the class, not all there are.
    """
    return near_duplicates(docs, least, size, draws, kept, seed, id_col, text_col)[0]


def near_duplicates(docs: DataFrame, least: float, size: int, draws: int, kept: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``classes``, and the verified links between the smallest ids of equal texts: src, dst."""
    rng = np.random.default_rng(seed)
    odd = lambda *shape: rng.integers(0, 1 << 63, size=shape, dtype=U) * U(2) + U(1)
    keys, weights, short_keys = odd(draws, 1), odd(1, kept), odd(SHORT_DRAWS, 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, sig2, drawn = [], [], [], []
            for own, labels, short in sequences_of(batch.column(1), size):
                n.append(len(own))
                if not len(own):
                    sig.append(None), sig2.append(None), drawn.append(None)
                    continue
                place = np.arange(len(own), dtype=U)
                sig.append(int((mixed(own + place)).sum().view(np.int64)))
                sig2.append(int((mixed(own ^ mixed(place + U(1)))).sum().view(np.int64)))
                found = _draws(labels, keys, weights)
                drawn.append((found if short is None else np.concatenate((found, _draws(short, short_keys, weights)))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(sig, pa.int64()), pa.array(sig2, pa.int64()), pa.array(drawn, pa.list_(pa.int64()))], ["doc_id", "n", "sig", "sig2", "draws"])

    sketches = written(named.mapInArrow(sketch, SKETCH), "draws")
    same = sketches.where("n > 0").groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("rep"), F.first("draws").alias("draws"), F.count("*").alias("copies"))
    same = written(same, "texts")
    members = same.select(F.col("rep").alias("id"), "n", F.explode("draws").alias("draw")).distinct()
    sizes = members.groupBy("draw").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    buckets = written(members.join(sizes, "draw"), "buckets")

    bits = cells.bits_for(8 * docs.count())

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch.column(0).to_numpy().view(U) for batch in batches]
        yield cells.sent_batch(cells.sent(mixed(np.unique(np.concatenate(found))) if found else np.zeros(0, U), bits, many=True))

    wanted = cells.merged(buckets.select("id").mapInArrow(flags, cells.SENT), bits)

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().view(U)
            chosen = pa.RecordBatch.from_arrays([c.filter(pa.array(wanted.passes(mixed(ids)))) for c in batch.columns], ["doc_id", "text"])
            found = [own.astype("<u4").tobytes() for own, *_ in sequences_of(chosen.column(1), size)]
            yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(found, pa.binary())], ["doc_id", "sequence"])

    sequences = written(named.mapInArrow(sequence, SEQUENCE), "sequences")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [aligned(*(np.frombuffer(v.as_py(), "<u4") for v in pair), least) >= least for pair in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["src", "dst"])

    def linked(pairs: DataFrame) -> DataFrame:
        one = sequences.select(F.col("doc_id").alias("src"), F.col("sequence").alias("first"))
        two = sequences.select(F.col("doc_id").alias("dst"), F.col("sequence").alias("second"))
        return pairs.join(one, "src").join(two, "dst").select("src", "dst", "first", "second").mapInArrow(verify, "src long, dst long")

    maps: list[DataFrame] = []  # the components so far, at most one table

    def of(rows: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
        """The column's ids replaced by their components so far, or by those of another table."""
        for table in maps if known is None else [known]:
            to = table.select(F.col("id").alias(name), F.col("component").alias("to__"))
            rows = rows.join(to, name, "left").withColumn(name, F.coalesce("to__", name)).drop("to__")
        return rows

    proofs: list[DataFrame] = []

    def joined(links: DataFrame) -> None:
        """Join the components that links connect."""
        proofs.append(written(links.distinct(), "proofs"))
        edges = of(of(proofs[-1], "src"), "dst").where("src <> dst").distinct()
        edges = written(edges, "links")
        if not edges.isEmpty():
            onward = connected(edges)
            if maps:
                before = maps.pop()
                moved = of(before.select("id", "component"), "component", onward).select("id", "component")
                maps.append(written(moved.unionByName(onward.join(before, "id", "left_anti").select("id", "component")), "components"))
                dropped(before, onward)
            else:
                maps.append(onward)
        dropped(edges)

    def block(table: pa.Table) -> pa.Table:
        first, own, ids = (table.column(name).to_numpy() for name in ("first", "own", "id"))
        found = np.array(block_links(first, own, [np.frombuffer(v.as_py(), "<u4") for v in table.column("sequence")], least), np.int64).reshape(-1, 2)
        ends = ids[found]
        return pa.table({"src": pa.array(ends.min(axis=1, initial=np.iinfo(np.int64).max), pa.int64()), "dst": pa.array(ends.max(axis=1, initial=np.iinfo(np.int64).min), pa.int64())})

    def crowd_links(crowds: DataFrame) -> DataFrame:
        """Links of all pairs within the buckets of ``crowds`` (draw, id, n, own)."""
        parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / PART_WORDS)).cast("int")
        whole = crowds.groupBy("draw").agg(parts.alias("whole"))
        band = F.when(F.col("whole") == 1, 0).otherwise(F.floor(F.log("n") / F.lit(-math.log(least) + 1e-9))).cast("int")
        rows = crowds.join(whole, "draw").withColumn("band", band)
        sizes = rows.groupBy("draw", "band").agg(parts.alias("parts"))
        near = lambda step, name: sizes.select("draw", (F.col("band") + step).alias("band"), F.col("parts").alias(name))
        rows = rows.join(sizes, ["draw", "band"]).join(near(1, "below"), ["draw", "band"], "left").join(near(-1, "above"), ["draw", "band"], "left")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        cell = lambda low, p, q, wide, first: F.struct(low.alias("low"), p.alias("p"), q.alias("q"), F.lit(wide).alias("wide"), first.alias("first"))
        yes, no = F.lit(True), F.lit(False)
        same_band = F.transform(upto(F.col("parts")), lambda q: cell(F.col("band"), F.least("part", q), F.greatest("part", q), False, F.col("part") <= q))
        next_band = F.transform(upto(F.col("above")), lambda q: cell(F.col("band"), F.col("part"), q, True, yes))
        last_band = F.transform(upto(F.col("below")), lambda q: cell(F.col("band") - 1, q, F.col("part"), True, no))
        dealt = rows.withColumn("part", part).select("draw", "id", "own", F.explode(F.concat(same_band, next_band, last_band)).alias("cell")).select("draw", "id", "own", "cell.*")
        dealt = dealt.join(sequences.select(F.col("doc_id").alias("id"), "sequence"), "id")
        return dealt.groupBy("draw", "low", "p", "q", "wide").applyInArrow(block, "src long, dst long")

    placed = buckets.withColumn("own", F.col("id"))
    for turn in range(PICKS):
        chance = F.xxhash64("id", "draw", F.lit(turn))
        some = placed.where(F.pmod("draw", F.lit(FIRST)) == 0) if turn == 0 else placed
        heads = some.groupBy("draw").agg(F.min_by(F.struct(F.col("id").alias("head"), F.col("own").alias("main")), F.struct("n", chance) if turn == PICKS - 1 else chance).alias("h")).select("draw", "h.*")
        stars = some.join(heads, "draw").where("own <> main").select(F.least("head", "id").alias("src"), F.greatest("head", "id").alias("dst")).distinct()
        joined(linked(stars))
        before, placed = placed, written(of(buckets.withColumn("own", F.col("id")), "own"), "placed")
        dropped(before)
    main = placed.groupBy("draw", "own").agg(F.count("*").alias("many")).groupBy("draw").agg(F.max_by("own", F.struct("many", "own")).alias("main"), F.max("many").alias("most"))
    marked = written(placed.join(main, "draw").withColumn("crowded", (F.col("members") > CROWDED) & (F.col("members") - F.col("most") > STRAYS)), "marked")

    plain = marked.where("not crowded")
    other = plain.select("draw", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("own").alias("other_own"))
    able = (F.col("own") != F.col("other_own")) & (F.greatest("n", "other_n") * least <= F.least("n", "other_n"))
    rest = plain.where("own <> main").join(other, "draw").where(able).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()
    joined(linked(rest))
    crowds = written(of(marked.where("crowded").select("draw", "id", "n", F.col("own")), "own"), "crowds")
    joined(crowd_links(crowds))
    links = proofs[0]
    for more in proofs[1:]:
        links = links.unionByName(more)
    links = written(links.distinct(), "all-links")
    degrees = links.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    texts = of(same.select("n", "sig", "sig2", "copies", "rep", F.col("rep").alias("class_id")), "class_id").join(degrees, "rep", "left")
    texts = written(texts.select("n", "sig", "sig2", "copies", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "text-classes")
    found = unique_join(sketches.select("doc_id", "n", "sig", "sig2"), texts, ["n", "sig", "sig2"], "copies").select("doc_id", "class_id", "n_links")
    alone = sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = rows.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = written(found.unionByName(alone).unionByName(unnamed), "classes")
    dropped(sketches, same, buckets, sequences, placed, marked, crowds, texts, *proofs, *maps)
    return out, links
