"""Substring deduplication: windows of words that a document with a smaller id has too.

A window is ``window`` consecutive words of one document.  A word goes if it is
covered by a window whose word sequence also starts in a document with a
smaller id, judged on the input.

1. Count-min prefilter.  Each window is counted by its anchor, the smallest hash
   among the word runs of half its length that it holds.  Equal windows have
   equal anchors, so the anchor's count, and the count-min sketch merged from
   the tasks' sketches, never underestimate a window's count.  Neighbouring
   windows share anchors, so the sketch holds about one key for 13 windows.
2. Only windows estimated repeated are grouped, exactly.  Neighbours with one
   anchor form a block.  Blocks with equal word sequences are grouped first: the
   smallest id keeps its block, in all others it is covered.  Only the kept
   blocks of anchors that occur with different blocks are opened, and their
   windows grouped by anchor and window hash (128 bits together).

Null texts have no words.  Rows with a null id lose nothing and cover nothing.
Rows that share an id are one document where windows are compared, and are
judged each for its own text.  Documents shorter than the window lose nothing.
Other columns are ignored, whatever their names; an empty table gives no rows.
Equality is that of 128 bits of hashes (64 of the anchor, 64 of the block or
window), not of the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells
from .rolling import U, mixed, smallest, text_runs, words
from ..plans.joins import unique_join
from ..plans.scratch import written

BLOCKS = "anchor long, block long, doc_id long, sig long, begin int, n int"
WINDOWS = "anchor long, window long, doc_id long, sig long, begin int"


class _Blocks:
    """The blocks of a run of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        half = max(1, window // 2)
        self.words = words(data, offsets)
        self.at = self.words.within(window)
        self.anchors = smallest(self.words.runs(half), window - half + 1)[self.at]
        change = np.ones(len(self.at), bool)
        change[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.first = np.flatnonzero(change)
        self.n = np.diff(np.append(self.first, len(self.at)))
        self.begin = self.at[self.first]
        self.anchor = self.anchors[self.first]
        self.doc = np.searchsorted(self.words.bounds, self.begin, "right") - 1
        self.local = self.begin - self.words.bounds[self.doc]
        self.block = self.words.between(self.begin, self.begin + self.n + window - 1) if len(self.begin) else np.zeros(0, U)


def _kept_key(anchor: np.ndarray, block: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One key for a block of a document."""
    return mixed(mixed(anchor.astype(U) + block.astype(U) * U(3)) + doc.astype(U))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def covered(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Covered stretches of words: doc_id, sig (a hash of the row's text), begin, end."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    bits = cells.bits_for(128 * docs.count())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = []
        for batch in batches:
            for _, data, offsets in text_runs(batch.column(2)):
                own = _Blocks(data, offsets, window)
                order = np.lexsort((own.anchor, own.doc))
                doc, anchor = own.doc[order], own.anchor[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                keys.append(anchor[fresh])
        yield cells.sent_batch(cells.sent(np.concatenate(keys) if keys else np.zeros(0, U), bits))

    repeated = cells.merged(rows.mapInArrow(sketch, cells.SENT), bits)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs = (batch.column(k).to_numpy() for k in (0, 1))
            for at, data, offsets in text_runs(batch.column(2)):
                own = _Blocks(data, offsets, window)
                k = np.flatnonzero(repeated.passes(own.anchor))
                doc = own.doc[k] + at
                yield pa.RecordBatch.from_arrays(
                    [_signed(own.anchor[k]), _signed(own.block[k]), pa.array(ids[doc]), pa.array(sigs[doc]), pa.array(own.local[k].astype(np.int32)), pa.array(own.n[k].astype(np.int32))],
                    ["anchor", "block", "doc_id", "sig", "begin", "n"],
                )

    blocks = written(rows.mapInArrow(grouped, BLOCKS), "blocks")
    kept = written(blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("kept_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("rows")), "kept-blocks")
    copies = unique_join(blocks, kept.where("kept_id < last_id"), ["anchor", "block"], "rows").where("doc_id > kept_id")
    whole = copies.select("doc_id", "sig", "begin", (F.col("begin") + F.col("n") + (window - 1)).alias("end"))

    several = kept.groupBy("anchor").agg(F.count("*").alias("blocks"), F.min("kept_id").alias("least"), F.max("kept_id").alias("most")).where("blocks > 1 and least < most")
    opened = kept.join(several.select("anchor"), "anchor").select("anchor", "block", F.col("kept_id").alias("doc_id"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [_kept_key(*(batch.column(k).to_numpy().view(U) for k in range(3))) for batch in batches]
        yield cells.sent_batch(cells.sent(np.concatenate(keys) if keys else np.zeros(0, U), bits, many=True))

    unclear = cells.merged(opened.mapInArrow(flags, cells.SENT), bits)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs = (batch.column(k).to_numpy() for k in (0, 1))
            for at, data, offsets in text_runs(batch.column(2)):
                own = _Blocks(data, offsets, window)
                doc_ids = ids[own.doc + at]
                open_block = np.flatnonzero(unclear.passes(_kept_key(own.anchor, own.block, doc_ids.view(U))))
                of = np.repeat(np.arange(len(own.first)), own.n)
                chosen = np.zeros(len(own.first), bool)
                chosen[open_block] = True
                k = np.flatnonzero(chosen[of]) if len(of) else np.zeros(0, np.int64)
                doc = own.doc[of[k]]
                begin = own.at[k]
                yield pa.RecordBatch.from_arrays(
                    [_signed(own.anchors[k]), _signed(own.words.runs(window)[begin]), pa.array(ids[doc + at]), pa.array(sigs[doc + at]), pa.array((begin - own.words.bounds[doc]).astype(np.int32))],
                    ["anchor", "window", "doc_id", "sig", "begin"],
                )

    windows = written(rows.mapInArrow(single, WINDOWS), "windows")
    least = written(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("kept_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("rows")).where("kept_id < last_id"), "kept-windows")
    parts = unique_join(windows, least, ["anchor", "window"], "rows").where("doc_id > kept_id").select("doc_id", "sig", "begin", (F.col("begin") + window).alias("end"))
    return whole.unionByName(parts)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(1).field("text"), batch.column(2)):
            own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            keep = np.ones(len(own), bool)
            for span in spans.as_py() or ():
                keep[span["begin"] : span["end"]] = False
            left = own if keep.all() else [own[i] for i in np.flatnonzero(keep)]
            n_words.append(len(own))
            n_removed.append(len(own) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "row", "n_words", "n_removed", "kept"])


def with_kept(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the text and all columns of ``docs`` as a struct ``row``, its words, how many go, and the UTF-8 of those kept.

    ``row`` holds a field text, and the row's own columns in a struct ``all``, so
    that no name clashes.
    """
    spans = covered(docs, window, id_col, text_col).groupBy("doc_id", "sig").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    whole = F.struct(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("all") if len(docs.columns) > 1 else F.lit(None).alias("all"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("sig"), whole.alias("row"))
    joined = rows.join(spans, ["doc_id", "sig"], "left").select("doc_id", "row", "spans")
    schema = joined.select("doc_id", "row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(b"").alias("kept")).schema
    return joined.mapInArrow(_removed, schema)


def without_repeats(docs: DataFrame, window: int = 50, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its words, how many go, and those kept joined by single spaces (with ``digests`` the SHA-256 of that)."""
    found = with_kept(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), window)
    kept = F.sha2("kept", 256) if digests else F.decode("kept", "UTF-8")
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept"))


def trimmed(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with the words that go taken out of the text.

    A row none of whose words stays goes; an untouched text, null or empty ones
    included, stays as it is.  A column ``n_chars`` follows a changed text.
    """
    found = with_kept(docs, window, id_col, text_col)
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("row.text")).otherwise(F.decode("kept", "UTF-8"))

    def column(name: str) -> Column:
        if name == text_col:
            return text.alias(name)
        own = F.col("row.all")[name]
        if name == "n_chars":
            own = F.when(whole, own).otherwise(F.char_length(text).cast(docs.schema[name].dataType))
        return own.alias(name)

    return found.where(whole | (F.col("n_removed") < F.col("n_words"))).select(*map(column, docs.columns))
