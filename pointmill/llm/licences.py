"""License scans: exact phrases, and short notices within a few edits.

Every text is lower-cased in A-Z and cut into words (runs of a-z, 0-9 and
non-ASCII characters); phrases and notices are looked for in the words joined
by single spaces.  A notice with at most k edits is cut into k+1 pieces, one of
which must occur unchanged (pigeonhole), so exact finds of the pieces locate all
candidates; the regex library's bounded-error matching then verifies the
neighbourhood of each and reports the span and its edits.  In each neighbourhood
the best match comes first, and the text before and after it is searched again,
so spans of one notice don't overlap, and every run of words within the edits
overlaps a reported one that needs no more.

Null and empty texts have no words, no labels and score 0.  Texts of any length
are scanned whole.  Repeated rows are scanned each for itself; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Notice(NamedTuple):
    """A short notice: its normalised words, the label it gives and the edits (characters) it allows."""

    words: str
    label: str
    edits: int


#: The notices looked for with errors.
NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("gnu free documentation license", "gfdl", 3),
    Notice("licensed under the apache license", "apache", 3),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person", "mit", 5),
    Notice("the software is provided as is without warranty of any kind", "mit", 5),
    Notice("licensed under a creative commons attribution", "cc-by", 4),
    Notice("creative commons zero", "cc0", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("european union public licence", "eupl", 3),
    Notice("boost software license", "bsl", 2),
    Notice("business source license", "busl", 2),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    Notice("this software is provided as is without any express or implied warranty", "zlib", 6),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
    Notice("sil open font license", "ofl", 2),
)
OUT = "doc_id long, n_words long, base array<struct<word: long, label: string>>, found array<struct<label: string, first_word: long, n_words: long, begin: long, end: long, edits: long>>, score double"
#: A-Z lower-cased; every other ASCII character that is no letter or digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalised(text: str | None) -> tuple[int, str]:
    """Number of words, and the words with single spaces between and around them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return len(words), f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """The edits + 1 pieces of a notice, with their places."""
    n, k = len(notice.words), notice.edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice.words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds phrases and notices in one normalised text after another."""

    def __init__(self, phrases: dict[str, str], notices: tuple[Notice, ...]) -> None:
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices = [(n, seeds(n), regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])")) for n in notices]

    def base(self, line: str) -> list[tuple[int, str]]:
        """All places of the phrases, as the number of their first word."""
        out = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                out.append((line.count(" ", 0, at), label))
                at = line.find(phrase, at + 1)
        return sorted(out)

    def fuzzy(self, line: str) -> list[dict]:
        """Places of the notices; begin and end are characters of the normalised words without the space before them."""
        out, absent = [], {}
        for notice, pieces, verify in self.notices:
            spans, slack = [], notice.edits
            for offset, piece in pieces:
                if absent.get(piece):
                    continue
                at = line.find(piece)
                absent[piece] = at < 0
                while at >= 0:
                    spans.append((max(0, at - offset - slack - 1), at - offset + len(notice.words) + slack + 1))
                    at = line.find(piece, at + 1)
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:  # whole words only, as the end of a searched part counts as the end of a word
                end = line.find(" ", b)
                for m in _verified(verify, line, line.rfind(" ", 0, a + 1) + 1, len(line) if end < 0 else end):
                    begin, end = m.span()
                    out.append({"label": notice.label, "first_word": line.count(" ", 0, begin) - 1, "n_words": line.count(" ", begin, end) + 1, "begin": begin - 1, "end": end - 1, "edits": sum(m.fuzzy_counts), "of": len(notice.words)})
        return sorted(out, key=lambda x: (x["begin"], x["end"], x["label"]))


def _verified(pattern: regex.Pattern, line: str, a: int, b: int) -> Iterator[regex.Match]:
    """The best match between two places, then those on either side of it."""
    parts = [(a, b)]
    while parts:
        a, b = parts.pop()
        m = pattern.search(line, a, b, concurrent=False) if a < b else None
        if m and m.end() > m.start():
            yield m
            parts += [(a, m.start() - 1), (m.end() + 1, b)]


def scanned(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its words, the places of the phrases, those of the notices, and a score.

    The score is 1 for a phrase, else the best share of a notice's characters
    that need no edit, and 0 where nothing is found.
    """
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, schema = Scanner(phrases, notices), None
        kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        spans = pa.list_(pa.struct([(n, pa.string() if n == "label" else pa.int64()) for n in ("label", "first_word", "n_words", "begin", "end", "edits")]))
        for batch in batches:
            n_words, base, found, score = [], [], [], []
            for text in batch.column(1):
                n, line = normalised(text.as_py())
                own, near = scan.base(line), scan.fuzzy(line)
                n_words.append(n)
                base.append([{"word": w, "label": x} for w, x in own])
                score.append(1.0 if own else max((max(0.0, 1 - x["edits"] / x["of"]) for x in near), default=0.0))
                found.append([{k: v for k, v in x.items() if k != "of"} for x in near])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, kind), pa.array(found, spans), pa.array(score, pa.float64())], ["doc_id", "n_words", "base", "found", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)
