"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, cut further at some sentence ends (told by
the character that follows), what is still long before words of some hashes, and
what has no words into equal lengths.  So an edit moves no cut but those next to
it, in any script and case.  Each paragraph is reduced to a 64-bit
digest; the set of different digests goes into a sketch of 24 cells, three per
digest, that hold a count and the exclusive ors of digests and of their checks.
Two versions' sketches are subtracted cell by cell, which leaves only the
differing digests, and peeling recovers them: a cell that holds one digest gives
it away, its removal from its other cells opens more.

If that fails, both versions are sketched anew in a larger size: many tables of
24 cells, as many as the differing digests need (their number is measured on one
digest in sixteen), with the digest choosing the table.  A table that can't be
peeled is sketched again as eight tables with other cells, in up to ``RETRIES``
rounds; what is left then, a few digests of one table, is compared as it is.  So
every likeness counts all differing digests.

All of it is expressions over rows, without Python on the executors.

Null texts count as empty; two texts without paragraphs have likeness 1.  Rows
with a null id come after all others, in an order by their text, as do rows that
share an id among themselves; other columns are ignored.  An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES, SLOTS, ROUNDS, RETRIES, PER_TABLE = 3, 8, 10, 2, 7
#: Levels of eight by which a larger sketch grows, and the digest's bit from which on they are dealt out.
LEVELS, DEALT_FROM = 7, 61
RANGES, PER_RANGE, PER_BUCKET = 64, 1024, 64
#: Line ends, and sentence ends before some letters, a digit, a quote, or any character that is not ASCII.
CUT = r"[\n\r\u2028\u2029]+|(?<=[.!?])\s+(?=[A-Ha-h0-9\"'(]|[^\x00-\x7F])|(?<=[\u3002\uFF01\uFF1F\u061F\u0964])\s*"
#: Pieces of over ``LONG`` characters are cut before one word in sixteen, those of over ``LONGER`` still at equal lengths.
LONG, LONGER, MARK, EQUAL = 600, 4000, "\x01", r"(?s)(?<=\G.{1000})"


_BITS = f"array({', '.join(str(1 << i) for i in range(TABLES * SLOTS))})"
_SUMS = "named_struct('n', {a}.n + {sign}{n}, 'k', {a}.k ^ {b}.k, 'h', {a}.h ^ {b}.h)"

# The expressions over digests are SQL text: parsed at once, they are far quicker to build than column by column.


def check(digest: str) -> str:
    """32 bits that tell a single digest from an exclusive or of several."""
    return f"shiftrightunsigned(xxhash64({digest}), 32)"


def bits_of(digest: str, low: int, mask: int = 7) -> str:
    """Some bits of a digest as a number."""
    return f"(shiftrightunsigned({digest}, {low}) & {mask})"


def member(digest: str, n: str = "1", again: int = 0) -> str:
    """A digest with a bit for each of its three cells and its check; each round ``again`` has other cells."""
    bits = [f"shiftleft({1 << (SLOTS * t)}, cast({bits_of(digest, 3 * (t + TABLES * again), SLOTS - 1)} AS int))" for t in range(TABLES)]
    return f"named_struct('k', {digest}, 'm', {' | '.join(bits)}, 'h', {check(digest)}, 'n', {n})"


def pieces(text: Column) -> Column:
    """The paragraphs of a text, in order."""
    finer = lambda parts, size, cut: F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > size, cut(x)).otherwise(F.array(x))))
    marked = lambda w: F.when(F.xxhash64(w).bitwiseAND(F.lit(15)) == 0, F.concat(F.lit(MARK), w)).otherwise(w)
    by_words = lambda x: F.split(F.array_join(F.transform(F.split(x, r"\s+"), marked), " "), MARK)
    cut = finer(F.split(text, CUT), LONG, by_words)
    return F.filter(F.when(F.length(text) > LONGER, finer(cut, LONGER, lambda x: F.split(x, EQUAL))).otherwise(cut), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """The different paragraphs of a text as digests with their cells: an array of k, m, h, n."""
    digests = F.array_distinct(F.transform(pieces(text), lambda x: F.xxhash64(x)))
    return F.transform(digests, lambda k: _struct(k))


def _struct(digest: Column) -> Column:
    """``member`` of a column."""
    bits = [F.call_function("shiftleft", F.lit(1 << (SLOTS * t)), F.shiftrightunsigned(digest, 3 * t).bitwiseAND(F.lit(SLOTS - 1)).cast("int")) for t in range(TABLES)]
    return F.struct(digest.alias("k"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("m"), F.shiftrightunsigned(F.xxhash64(digest), 32).alias("h"), F.lit(1).alias("n"))


def sketch(members: str) -> str:
    """The 24 cells of some paragraphs."""
    add = _SUMS.format(a="c", b="x", sign="", n="1")
    return f"transform({_BITS}, bit -> aggregate(filter({members}, x -> (x.m & bit) != 0), named_struct('n', 0, 'k', 0L, 'h', 0L), (c, x) -> {add}))"


def subtracted(one: str, two: str) -> str:
    """Cells of the first less those of the second."""
    return f"zip_with({one}, {two}, (c, d) -> {_SUMS.format(a='c', b='d', sign='-', n='d.n')})"


def peeled(cells: str, again: int = 0) -> str:
    """Whether all digests of a difference were recovered, and how many of either side: ok, left, right."""
    found = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.h = {check('c.k')}), c -> {member('c.k', 'c.n', again)}))"
    drop = _SUMS.format(a="c", b="p", sign="-", n="p.n")
    rest = f"zip_with(s.cells, {_BITS}, (own, bit) -> aggregate(filter(f, p -> (p.m & bit) != 0), own, (c, p) -> {drop}))"
    ours = "size(filter(f, p -> p.n = 1))"
    state = lambda cells, left, right, done: f"named_struct('cells', {cells}, 'left', {left}, 'right', {right}, 'done', {done})"
    ended = state("s.cells", "s.left", "s.right", "true")
    removed = state(rest, f"s.left + {ours}", f"s.right + size(f) - {ours}", "false")
    step = f"element_at(transform(array({found}), f -> if(size(f) = 0, {ended}, {removed})), 1)"
    end = f"aggregate(sequence(1, {ROUNDS}), {state(cells, '0', '0', 'false')}, (s, i) -> if(s.done, s, {step}))"
    return f"element_at(transform(array({end}), s -> named_struct('ok', NOT exists(s.cells, c -> c.n != 0 OR c.k != 0), 'left', s.left, 'right', s.right)), 1)"


def _by_bits(members: str, low: int) -> str:
    """Eight lists by three bits of the digests."""
    return f"transform(sequence(0, 7), i -> filter({members}, x -> {bits_of('x.k', low)} = i))"


def _counts(found: str) -> str:
    """The differing digests of either side recovered so far, and those that some results hold."""
    total = lambda side: f"got__.{side} + aggregate({found}, 0, (n, r) -> n + r.{side})"
    return f"named_struct('left', {total('left')}, 'right', {total('right')})"


def needed(one: str, two: str) -> str:
    """Tables that a larger sketch of both needs, by the digests that differ among one in sixteen, or by all if they are few."""
    some = [f"transform(filter({x}, m -> {bits_of('m.k', 28, 15)} = 0), m -> m.k)" for x in (one, two)]
    both = f"(size({one}) + size({two}))"
    differing = f"if({both} < {16 * PER_TABLE}, {both}, least({both}, 16 * (size(array_except({some[0]}, {some[1]})) + size(array_except({some[1]}, {some[0]}))) + {2 * PER_TABLE}))"
    return f"greatest(ceil({differing} / {float(PER_TABLE)}D), 1)"


def with_likeness(rows: DataFrame, name: str, one: str, two: str, cells_one: str, cells_two: str) -> DataFrame:
    """Column ``name``: shared paragraphs by all, from the recovered differences of two fingerprints.

    First both fingerprints, then the larger sketch: ``a__`` and ``b__`` hold the
    digests of either side by table, only of tables not yet peeled, and ``got__``
    the differing digests recovered so far.
    """
    sides = {"a__": one, "b__": two}
    added = lambda rows, **columns: rows.withColumns({k: F.expr(v) for k, v in columns.items()})
    rows = added(rows, each__=peeled(subtracted(cells_one, cells_two)))
    rows = added(rows, got__="if(each__.ok, named_struct('left', each__.left, 'right', each__.right), named_struct('left', 0, 'right', 0))", tables__=f"if(each__.ok, NULL, {needed(one, two)})")
    rows = added(rows, levels__="cast(floor(log(8, tables__ + 0.5D)) AS int)")
    rows = added(rows, wide__="cast(coalesce(ceil(tables__ / pow(8D, levels__)), 0) AS int)")
    first = "transform(if(wide__ > 0, sequence(0, wide__ - 1), cast(array() AS array<int>)), i -> filter({}, x -> pmod(shiftrightunsigned(x.k, 32), wide__) = i))"
    rows = added(rows, **{k: first.format(members) for k, members in sides.items()})
    for level in range(LEVELS):
        rows = added(rows, **{k: f"if(levels__ > {level}, flatten(transform({k}, l -> {_by_bits('l', DEALT_FROM - 3 * level)})), {k})" for k in sides})
    for turn in range(RETRIES + 1):
        if turn:
            split = _by_bits("t.{}", DEALT_FROM - 3 * (LEVELS + turn - 1))
            rows = added(rows, **{k: f"flatten(transform(failed__, t -> transform({split.format(k)}, l -> transform(l, m -> {member('m.k', again=turn)}))))" for k in sides})
        rows = added(rows, each__=f"zip_with(a__, b__, (a, b) -> {peeled(subtracted(sketch('a'), sketch('b')), turn)})")
        rows = added(rows, got__=_counts("filter(each__, r -> r.ok)"), failed__="filter(arrays_zip(a__, b__, each__), t -> NOT t.each__.ok)")
    digests = lambda side: f"transform(t.{side}, m -> m.k)"
    differing = lambda a, b: f"size(array_except({digests(a)}, {digests(b)}))"
    rows = added(rows, got__=_counts(f"transform(failed__, t -> named_struct('left', {differing('a__', 'b__')}, 'right', {differing('b__', 'a__')}))"))
    rows = added(rows, **{name: f"if(size({one}) = 0 AND size({two}) = 0, 1D, (size({one}) - got__.left) / (size({one}) + got__.right))"})
    return rows.drop("a__", "b__", "got__", "tables__", "levels__", "wide__", "each__", "failed__")


def printed(cells: Column) -> Column:
    """A sketch as text: base 64 of count (2 bytes), digests (8) and checks (4) of each cell."""
    pad = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(cells, lambda c: F.concat(pad(c.n.bitwiseAND(F.lit(0xFFFF)), 4), pad(c.k, 16), pad(c.h, 8))), ""))), "\r\n", "")


def _buckets(ids: DataFrame) -> Column:
    """The bucket of a row (doc_id, text_hash): ranges of ids that hold about as many rows each.

    ``RANGES`` quantiles, each cut evenly into up to ``PER_RANGE``, so that a few
    far ids stretch one range alone.  Differences are doubles, which rise with the
    ids and can't overflow.  Rows without an id are dealt out by ranges of their
    hash, in buckets below 0.
    """
    each = max(1, min(PER_RANGE, ids.count() // (PER_BUCKET * RANGES)))
    null = -1 - F.floor((F.shiftright("text_hash", 32) + (1 << 31)) / F.lit(float((1 << 32) // each + 1))).cast("long")
    quantiles = F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 10_000)
    low, high, cuts = ids.where(F.col("doc_id").isNotNull()).agg(F.min("doc_id"), F.max("doc_id"), quantiles).head()
    if low is None:
        return null
    starts, id_ = sorted({low, *cuts}), F.col("doc_id")
    bucket = F.when(id_.isNull(), null)
    for i in reversed(range(len(starts))):
        width = ((starts[i + 1] if i + 1 < len(starts) else high + 1) - starts[i]) / each
        at = F.floor((id_.cast("double") - F.lit(float(starts[i]))) / F.lit(width)).cast("long")
        bucket = bucket.when(id_ >= F.lit(starts[i]), F.least(F.greatest(at, F.lit(0)), F.lit(each - 1)) + i * each)
    return bucket.otherwise(F.lit(0)).cast("long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Columns doc_id, text, text_hash, next_text, bucket, late, and the window in which rows stand by descending id.

    The ids alone give buckets of neighbouring ids; the texts are shuffled once,
    by bucket.  The first row of each goes along to the bucket before it as its
    last row (``late``), that of the first to the last; there are at most
    ``RANGES`` times ``PER_RANGE`` buckets, and ``PER_RANGE`` of rows without an
    id, whose first rows are all that reaches the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    bucket = _buckets(rows.select("doc_id", "text_hash"))
    nameless = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    firsts = rows.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head"), F.min(nameless).alias("hash")).collect()
    heads = sorted((r["bucket"], r["head"], r["hash"]) for r in firsts)
    lent = [(head, hash_, heads[(i + 1) % len(heads)][0]) for i, (_, head, hash_) in enumerate(heads)]
    key = lambda id_, hash_: F.struct(id_.isNull(), F.coalesce(id_, hash_))
    lent_df = docs.sparkSession.createDataFrame(lent, "head long, hash long, lent_to long").select(key(F.col("head"), F.col("hash")).alias("key"), "lent_to")
    rows = rows.withColumn("key", key(F.col("doc_id"), F.col("text_hash"))).join(F.broadcast(lent_df), "key", "left")
    places = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("late")), F.when(F.col("lent_to").isNotNull(), F.struct(F.col("lent_to").alias("bucket"), F.lit(1).alias("late")))))
    placed = rows.select("doc_id", "text", "text_hash", F.explode(places).alias("place")).select("doc_id", "text", "text_hash", "place.*")
    order = Window.partitionBy("bucket").orderBy("late", F.desc_nulls_last("doc_id"), "text_hash")
    return placed.withColumn("next_text", F.lead("text").over(order)), order


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """The rows and window of ``with_next``, with n_chars and edited: the last third replaced by the beginning of the next text."""
    rows, order = with_next(docs, id_col, text_col)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - third)
    return rows.withColumn("edited", F.concat(kept, F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), third))), order


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and the likeness to the edited and to the next text."""
    rows, order = with_edited(docs, id_col, text_col)
    rows = rows.select("doc_id", "bucket", "late", "text_hash", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("other"))
    rows = rows.withColumns({"own_cells": F.expr(sketch("own")), "other_cells": F.expr(sketch("other"))})
    rows = rows.withColumn("next", F.lead("own").over(order)).withColumn("next_cells", F.lead("own_cells").over(order)).where("late = 0")
    rows = with_likeness(rows, "near_edited", "own", "other", "own_cells", "other_cells")
    rows = with_likeness(rows, "near_next", "own", "next", "own_cells", "next_cells")
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(F.col("own_cells")).alias("fingerprint"), printed(F.col("other_cells")).alias("edited_fingerprint"), "near_edited", "near_next", F.size("own").alias("n_paragraphs"))
