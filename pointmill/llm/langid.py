"""Language identification by word-first backoff.

The model holds, per language, the log frequency of every word of the training
texts, and the log frequencies of character n-grams (word edges marked) of
lengths 1 to 4 taken from the same words.  A known word scores by its word
frequencies; a word that no language knows scores by the n-grams of length 4,
those of its n-grams that are unseen by those of length 3 they consist of, and
so on to single characters, and past them a constant that favours no language.

Training counts words of a sample of the labelled texts, whole texts, of about
``max_docs`` documents picked by a hash of the document id; what reaches the
driver is the words that occur at least ``min_count`` times there, so the model
is bounded whatever the size of the table.

A null text, or one without a letter, gets ``und`` and score 0; so does every
text if nothing could be learned.  Ties go to the alphabetically first
language.  Repeated rows are judged each, texts of any length whole; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
OUT = "doc_id long, lang_pred string, score double"
LONGEST = 4
#: Marks of a word's edges; alone they speak for no language.
EDGES = ("^", "$")
KEPT_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")


class Backoff:
    """Scores words per language."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        """``counts``: occurrences by language, then word."""
        self.langs = sorted(counts)
        n = len(self.langs)
        words: dict[str, list[int]] = defaultdict(lambda: [0] * n)
        grams: list[dict[str, list[int]]] = [defaultdict(lambda: [0] * n) for _ in range(LONGEST)]
        for k, lang in enumerate(self.langs):
            for word, count in counts[lang].items():
                words[word][k] += count
                marked = f"^{word}$"
                for size in range(1, LONGEST + 1):
                    for i in range(len(marked) - size + 1):
                        grams[size - 1][marked[i : i + size]][k] += count
        self.words = self._logs(words)
        self.grams = [self._logs(g) for g in grams]
        self.kept: dict[str, tuple[float, ...]] = {}

    @classmethod
    def of(cls, langs: list[str], words: dict, grams: list[dict]) -> Backoff:
        """A model from its tables."""
        own = cls.__new__(cls)
        own.langs, own.words, own.grams, own.kept = langs, words, grams, {}
        return own

    def _logs(self, table: dict[str, list[int]]) -> dict[str, tuple[float, ...]]:
        sums = [sum(c[k] for c in table.values()) + len(table) / 2 for k in range(len(self.langs))]
        return {x: tuple(math.log((c + 0.5) / (s or 1)) for c, s in zip(own, sums)) for x, own in table.items()}

    def _gram(self, gram: str) -> tuple[float, ...]:
        found = self.grams[len(gram) - 1].get(gram)
        if gram in EDGES or found is None and len(gram) == 1:
            return (0.0,) * len(self.langs)
        if found is not None:
            return found
        parts = [self._gram(gram[:-1]), self._gram(gram[1:])]
        return tuple(sum(x) / 2 for x in zip(*parts))

    def word(self, word: str) -> tuple[float, ...]:
        """The word's score in each language, the largest being 0."""
        kept = self.kept.get(word)
        if kept is None:
            raw = self.words.get(word)
            if raw is None:
                marked = f"^{word}$"
                size = min(LONGEST, len(marked))
                each = [self._gram(marked[i : i + size]) for i in range(len(marked) - size + 1)]
                raw = tuple(sum(x) / len(each) for x in zip(*each))
            top = max(raw)
            kept = tuple(x - top for x in raw)
            if len(self.kept) >= KEPT_WORDS:
                self.kept = {}
            if len(word) <= 64:
                self.kept[word] = kept
        return kept

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its share of the posterior."""
        found = Counter(_WORD.findall((text or "").lower()))
        if not self.langs or not any(map(_lettered, found)):
            return UNDETERMINED, 0.0
        total = [0.0] * len(self.langs)
        for word, n in found.items():
            for k, x in enumerate(self.word(word)):
                total[k] += n * x
        top = max(total)
        best = total.index(top)
        return self.langs[best], 1 / sum(math.exp(max(x - top, -700.0)) for x in total)


def _lettered(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, word) within the task, in runs that bound the table."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            for word, n in Counter(_WORD.findall(text.as_py().lower())).items():
                counts[lang, word] += n
            if len(counts) >= KEPT_WORDS:
                yield flush()
    yield flush()


def fitted(train: DataFrame, max_docs: int = 8000, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Backoff:
    """A model from the labelled rows of ``train``, at most about ``max_docs`` of them."""
    labelled = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = train.where(F.col(lang_col).isNotNull()).count()
    if rows > max_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * max_docs / rows))
    words = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_split, "lang string, word string, n long")
    found = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    table = found.toArrow()
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts[lang][word] = n
    return Backoff(dict(counts))


def identified(docs: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text, with the posterior share as score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Backoff.of(*shared.value)
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def kept(docs: DataFrame, model: Backoff, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language; with a model of no languages those with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))
    at = docs.columns.index(text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Backoff.of(*shared.value)
        told = (lambda text: own.predict(text)[0] != UNDETERMINED) if own.langs else (lambda text: any(map(_lettered, _WORD.findall((text or "").lower()))))
        for batch in batches:
            yield batch.filter(pa.array([told(text.as_py()) for text in batch.column(0).field(at)], pa.bool_()))

    return whole.mapInArrow(run, whole.schema).select(*(F.col("row")[c].alias(c) for c in docs.columns))
