"""Packing by concatenate-and-cut.

All documents form one token stream.  Pass one tokenises each document once and
writes, per document, its ids and its start within its partition; the token
totals of the partitions then give, as prefix sums, each partition's global
offset.  Pass two cuts every document at the multiples of the window, without
any further shuffle: the boundary records are the pieces a window edge leaves
on either side of it.

Null texts count as empty (the end id alone).  An empty table gives no pieces.
Repeated rows are separate documents.  Columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

TOKENS = "part int, doc_id long, local_start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words a Python worker's table takes before it becomes the older generation.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
#: str.split() takes these for white space, Unicode (and the tokenizer) doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Letters and numbers below U+0250 as they are after lower-casing; there NFC changes nothing, and only U+0130 lower-cases to two characters.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼½¾"
_PLAIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*")
_PART = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Generations:
    """A table of two generations: what the older one still holds is kept when it is used again.

    It bounds memory and changes no result; ``found`` makes the values of new keys.
    """

    def __init__(self, found, kept: int = KEPT_WORDS) -> None:
        self.found, self.kept, self.new, self.old = found, kept, {}, {}

    def ready(self, keys: set) -> dict:
        """A table that has all the keys."""
        if len(self.new) >= self.kept:
            self.new, self.old = {}, self.new
        table, old, missing = self.new, self.old, []
        for key in keys.difference(table):
            value = old.get(key)
            if value is None:
                missing.append(key)
            else:
                table[key] = value
        table.update(zip(missing, self.found(missing)))
        return table


class WordIds:
    """Ids of a tokenizer that drops white space and never joins across it, word by word.

    A distinct word is segmented once while it stays in the table.  Words of
    Latin letters, numbers and signs go straight to the vocabulary's BPE model;
    any other word, and one that may hold a special token, goes through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        kinds = [made["normalizer"]["type"], *(x["type"] for x in made["normalizer"].get("normalizers", ())), *(x["type"] for x in made["pre_tokenizer"].get("pretokenizers", ()))]
        if kinds != ["Sequence", "NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("not a tokenizer of lower-cased words without white space")
        self.special = [x["content"] for x in made["added_tokens"]]
        self.code, self.kind = ("H", "<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.model, self.bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts, self.words = Generations(self._parts), Generations(self._words)

    def _parts(self, parts: list[str]) -> list[bytes]:
        tokenize, code, out = self.model.tokenize, self.code, []
        for part in parts:
            level = part if part.isascii() and part.isprintable() else "".join(x for x, _ in self.bytes.pre_tokenize_str(part))
            out.append(array(code, [t.id for t in tokenize(level)]).tobytes())
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        plain, special = _PLAIN.fullmatch, re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        joined = "\n".join(words)
        odd = set() if plain(joined) else {w for w in words if not plain(w)}
        if special(joined):
            odd.update(filter(special, words))
        split = [None if w in odd else _PART.findall(w.lower()) for w in words]
        table = self.parts.ready({p for parts in split if parts for p in parts})
        return [self._whole(w) if parts is None else table[parts[0]] if len(parts) == 1 else b"".join([table[p] for p in parts]) for w, parts in zip(words, split)]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of ``kind``."""
        words = [[t] if _NOT_SPACE.search(t) else t.split() for t in texts]
        long = {w for w in set().union(*words) if len(w) > KEPT_CHARS}
        table = self.words.ready(set().union(*words) - long)
        if long:
            table = table | {w: self._words([w])[0] for w in long}
        return [b"".join([table[x] for x in w]) for w in words]


_WORKER: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def slices(column: pa.Array, chars: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` characters, with the first one's row; nulls become empty."""
    begun, rows, held = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        rows.append(text)
        held += len(text)
        if held >= chars:
            yield begun, rows
            begun, rows, held = i + 1, [], 0
    if rows:
        yield begun, rows


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: a row per document with its ids and its start in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, at = _word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], ids.kind).tobytes(), int(ids.kind[-1])
        for batch in batches:
            for begun, texts in slices(batch.column(1)):
                blobs = [b + end for b in ids.encode(texts)]
                sizes = np.array([len(b) // width for b in blobs], "i8")
                starts = at + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(blobs), part, "i4")), batch.column(0).slice(begun, len(blobs)), pa.array(starts), pa.array(sizes), pa.array(blobs, pa.binary())],
                    ["part", "doc_id", "local_start", "doc_tokens", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, TOKENS)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, begin, size, blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                at, ids = 0, np.frombuffer(blob, f"<u{len(blob) // size}").astype("<u4")
                while at < size:
                    sequence, offset = divmod(begin + at, window)
                    length = min(window - offset, size - at)
                    rows.append((doc, at, length, zlib.crc32(ids[at : at + length]), size, sequence, offset))
                    at += length
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens; only the last sequence may be shorter.

    What reaches the driver is one total for each partition of the scan.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    totals = sorted(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    starts = spark.createDataFrame(offsets, "part int, part_start long")
    placed = tokens.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("begin"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(window), PIECES)
