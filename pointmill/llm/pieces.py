"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model none of whose pieces holds a white-space marker after another
character, no piece reaches from one marked word (a run of markers with what
follows) into the next.  So each distinct marked word of the corpus is segmented
once, and the ids are joined back by position; a run decodes them word by word.  A model without that
property is refused.

1. Every text becomes numbers: the places of its marked words in the word list
   of its run, a stretch of about ``RUN_CHARS`` characters of neighbouring texts.
2. The runs' lists, cut into buckets by a hash of the word, meet by bucket; there
   each distinct word is segmented once, and what was found goes back to the runs
   that hold the word, in the order of their lists.
3. A run's numbers and what was found for its words meet in one task, and numbers
   turn into ids.

All three kinds of lists travel packed: a run's numbers as one row, its words and
what was found for them as one row for each bucket.  The number of buckets grows
with the words, so that a bucket's distinct words fit a task.

Numbers and words take one shuffle, by ``key``, which both steps read: words to the
task of their bucket, numbers to the one where what was found for their run will
come.  So nothing lies on the disk twice.  Should a lost part be made again from
texts that changed or came in another order, the marks of the lists differ, and
the job fails rather than mix the two.

Null texts count as empty: no ids, empty decoded text.  Texts and words of any
length are taken whole.  Other columns are ignored, whatever their names; repeated
rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices

MARK = "▁"
RUN_CHARS = 1 << 23
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
CODED = "key long, bucket int, size int, ids array<long>, counts array<int>, marks array<long>, packed binary"
FOUND = "of long, bucket int, size int, mark long, found binary"
OUT = "doc_id long, n_tokens long, ids string, decoded string"
#: Bytes of text for which there is a bucket of words, and the fewest buckets.
PER_BUCKET, LEAST_BUCKETS = 1 << 25, 16


class Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Segmenter:
    """Segments marked words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces such as {crossing[0]!r} cross a white-space marker")

    def found(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        ids = self.model.encode(words, num_threads=1)
        for i, word in enumerate(words):
            if not word:  # a marker alone, at the end of a text; the library encodes an empty text to nothing
                ids[i] = [self.model.piece_to_id(MARK)]
        return ids


def chunks(text: str) -> list[str]:
    """Marked words, each without its first marker, which the library adds itself."""
    if not text:
        return []
    words = text.split(" ")
    if MARK not in text and "" not in words:
        return words
    return [c[1:] for c in _CHUNK.findall(f" {text}")]


_WORKER: dict[str, Segmenter] = {}


def _segmenter(path: str) -> Segmenter:
    if path not in _WORKER:
        _WORKER[path] = Segmenter(path)
    return _WORKER[path]


def packed(words: list[str]) -> bytes:
    """Texts as one compressed value."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return zlib.compress(np.array([len(x) for x in data], "<u4").tobytes() + b"".join(data), 1)


def unpacked(blob: bytes, n: int) -> list[str]:
    """The n texts of ``packed``."""
    data = zlib.decompress(blob)
    ends = (4 * n + np.cumsum(np.frombuffer(data, "<u4", n))).tolist()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([4 * n, *ends], ends)]


def packed_ids(ids: list[list[int]]) -> bytes:
    """Lists of ids as one compressed value: their lengths, then all ids."""
    sizes = np.array([len(x) for x in ids], "<u4")
    return zlib.compress(sizes.tobytes() + np.array([i for x in ids for i in x], "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_ids(blob: bytes, n: int) -> list[list[int]]:
    """The n lists of ``packed_ids``."""
    data = zlib.decompress(blob)
    ends = np.cumsum(np.frombuffer(data, "<u4", n)).tolist()
    ids = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=4 * n).reshape(4, -1).T).view("<u4").ravel().tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Run:
    """A stretch of texts as numbers, with its words."""

    def __init__(self, run: int) -> None:
        self.run, self.words, self.ids, self.codes, self.chars = run, Numbered(), [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        """Take in a text."""
        self.ids.append(doc_id)
        self.codes.append(array("I", map(self.words.__getitem__, chunks(text))))
        self.chars += len(text)

    def rows(self, buckets: int) -> pa.RecordBatch:
        """A row of numbers, and one for the words of each bucket; numbers follow the words' order by bucket.

        Numbers have the run as key, words their bucket as -1, -2 and so on, with the
        run in ``ids``; the marks of the lists stand with the numbers.
        """
        words = list(self.words)
        slots = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int64)
        order = np.argsort(slots, kind="stable")
        place = np.empty(len(words), "<u4")
        place[order] = np.arange(len(words))
        numbers = place[np.concatenate([np.frombuffer(c, "<u4") for c in self.codes])] if words else np.zeros(0, "<u4")
        planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
        cuts = np.searchsorted(slots[order], np.arange(buckets + 1))
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        blobs = [packed([words[i] for i in order[cuts[b] : cuts[b + 1]]]) for b in some]
        marks = [zlib.crc32(x) for x in blobs]
        rows = [(self.run, -1, len(words), self.ids, [len(c) for c in self.codes], marks, zlib.compress(planes, 1)), *((-1 - b, b, int(cuts[b + 1] - cuts[b]), [self.run], None, None, x) for b, x in zip(some, blobs))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "bucket", "size", "ids", "counts", "marks", "packed"])


def _coded(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        own = Run(base)
        for batch in batches:
            for begun, texts in slices(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(begun, len(texts)).to_pylist(), texts):
                    own.add(doc_id, text)
                if own.chars >= RUN_CHARS:
                    yield own.rows(buckets)
                    made += 1
                    own = Run(base + made)
        if own.ids:
            yield own.rows(buckets)

    return run


def round_trip(docs: DataFrame, model_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text, joined by commas, and the text they decode to.

    With ``digests`` the two texts are replaced by their SHA-256 where they are
    made, so that neither is sent back to the JVM.
    """

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, at = _segmenter(model_path), {}, None  # known: a bucket's words with their ids
        for batch in batches:
            for bucket, size, (run,), blob in zip(*(batch.column(k).to_pylist() for k in ("bucket", "size", "ids", "packed"))):
                if bucket != at:
                    known, at = {}, bucket
                words = unpacked(blob, size)
                new = [w for w in words if w not in known]
                known.update(zip(new, model.found(new)))
                row = (run, bucket, size, zlib.crc32(blob), packed_ids([known[w] for w in words]))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["of", "bucket", "size", "mark", "found"])

    def joined(texts: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids": [], "decoded": []}
        order, (own,) = np.argsort(found.column("bucket").to_numpy()), texts.to_pylist()
        if found.column("mark").to_numpy()[order].tolist() != own["marks"]:
            raise ValueError("the texts changed, or their order, while they were read")
        lists = [x for r in order for x in unpacked_ids(found.column("found")[r].as_py(), found.column("size")[r].as_py())]
        ids, decoded = [",".join(map(str, x)) for x in lists], _segmenter(model_path).model.decode(lists, num_threads=1) if lists else []
        planes = np.frombuffer(zlib.decompress(own["packed"]), np.uint8).reshape(4, -1)
        numbers, at = np.ascontiguousarray(planes.T).view("<u4").ravel().tolist(), 0
        for doc_id, n in zip(own["ids"], own["counts"]):
            places = numbers[at : at + n]
            at += n
            line, back = ",".join([ids[i] for i in places]), " ".join([decoded[i] for i in places])
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(line.count(",") + 1 if line else 0)
            out["ids"].append(hashlib.sha256(line.encode()).hexdigest() if digests else line)
            out["decoded"].append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.string(), "decoded": pa.string()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(LEAST_BUCKETS, math.ceil((rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) / PER_BUCKET))
    parts = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = rows.mapInArrow(_coded(buckets), CODED).repartition(parts, "key")
    # conditions that depend on the partition, and every column, so that neither moves before the shuffle and both steps read the same one
    key = F.when(F.spark_partition_id() >= 0, F.col("key"))
    found = coded.where(key < 0).sortWithinPartitions("bucket").mapInArrow(segmented, FOUND)
    return coded.where(key >= 0).groupBy("key").cogroup(found.groupBy("of")).applyInArrow(joined, OUT)
