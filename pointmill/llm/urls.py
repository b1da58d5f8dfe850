"""URL filters: a fixed rule list first, association rules for the rest.

Association rules are mined by Spark's FP-growth from URLs: the tokens of host
and path are the items, the label of a labelled URL is one more item, and a rule
{tokens} -> label is kept when its support, its confidence and its lift reach the
thresholds and no part of its tokens is a rule of the same label already.  URLs
without a label are mined too, as the contrast that confidence is measured
against: a token that stands in many URLs of no known label condemns none of
them.  Each URL is then matched by an inverted index from the rarest token of a
rule to the rule.

Where URLs have so many frequent tokens that FP-growth would meet too many
combinations (over ``MOST_SETS`` a URL on average), the same rules, at the same
support, are found by pattern growth that leaves out what gives no rule (``grown``);
no support is raised and no rule lost.  ``mined`` alone is FP-growth at a support that
rises instead; no verdict rests on it.

A null URL, or one without ``://``, has an empty host and path and no tokens;
it gets the default verdict.  An empty table gives no rows, a table without
labelled URLs no rules.  Repeated rows, and rows without an id, are judged each;
URLs of any length are judged whole; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import dropped, written

LABEL = "label="
#: Combinations of frequent tokens that a URL may have on average, and the supports that are tried.
MOST_SETS, STEPS = 1024, (1, 2, 5, 10, 20, 50)
#: Sets of tokens counted in one pass over the URLs, and cells of a block of URLs by tokens.
A_PASS, CELLS = 1 << 17, 1 << 26


class Rule(NamedTuple):
    """A fixed rule: the host it fits with its subdomains, the start of the path, and its verdict."""

    host: str
    path: str
    verdict: str


class Mined(NamedTuple):
    """An association rule that survived pruning."""

    tokens: tuple[str, ...]
    label: str
    confidence: float
    support: float


class Group(NamedTuple):
    """Sets to count: a prefix (with how many URLs hold it, of the label and at all) and each of the tokens that may follow."""

    label: int
    prefix: tuple[int, ...]
    own: int
    every: int
    tokens: list[int]


class Measured(NamedTuple):
    """Held-out labelled URLs, those that a mined rule fits, and those of them that get their own label."""

    urls: int
    judged: int
    right: int


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_value(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` (a string) of the longest rule that fits, else null."""
    order = sorted(rules, key=lambda r: -len(r.host) - len(r.path))
    fits = [((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in order]
    return F.coalesce(*(F.when(fit, F.lit(value(r))) for fit, r in zip(fits, order)), F.lit(None).cast("string"))


def tokens_of(host: Column, path: Column) -> Column:
    """Different tokens: the host's labels, and the path's words with numbers as one token."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x))
    return F.array_distinct(F.concat(labels, F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))))


def bounded_support(baskets: DataFrame, min_support: float, n: int) -> float:
    """The smallest of the tried supports at which the frequent tokens of a URL have few combinations on average.

    Tokens below ``min_support`` are left out before anything is collected; what
    is left are at most (mean tokens of a URL) / min_support.
    """
    counts = baskets.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= min_support * n)
    known = {r["item"]: r["count"] / n for r in counts.collect()}
    tried = [x for x in (min_support * step for step in STEPS) if x < 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0.0] * len(tried)
        for batch in batches:
            for items in batch.column(0).to_pylist():
                own = [known[x] for x in items if x in known]
                for k, support in enumerate(tried):
                    sums[k] += 2.0 ** min(64, sum(x >= support for x in own))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tried)), pa.int32()), pa.array(sums)], ["k", "sets"])

    sets = {r["k"]: r["sets"] for r in baskets.select("items").mapInArrow(run, "k int, sets double").groupBy("k").agg(F.sum("sets").alias("sets")).collect()}
    return next((x for k, x in enumerate(tried) if sets.get(k, 0.0) <= MOST_SETS * n), 1.0)


def baskets_of(rows: DataFrame) -> DataFrame:
    """The items of rows of ``tokens`` and ``label`` (null: unknown)."""
    label = F.when(F.col("label").isNotNull(), F.array(F.concat(F.lit(LABEL), "label"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), label).alias("items"))


def pruned(rules: list[Mined], default: str | None) -> list[Mined]:
    """The rules of which no part is a rule of the same label, without those of the label ``default``."""
    kept: list[Mined] = []
    by_token: dict[tuple[str, str], list[frozenset]] = {}
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.tokens, r.label)):
        own = frozenset(rule.tokens)
        if rule.label != default and not any(x <= own for t in own for x in by_token.get((rule.label, t), ())):
            by_token.setdefault((rule.label, rule.tokens[0]), []).append(own)
            kept.append(rule)
    return kept


def fp_rules(baskets: DataFrame, support: float, min_confidence: float, default: str | None) -> list[Mined]:
    """The pruned rules of FP-growth."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)) & (F.col("lift") > 1))
    return pruned([Mined(tuple(sorted(r["antecedent"])), r["consequent"][0][len(LABEL) :], r["confidence"], r["support"]) for r in found.collect()], default)


def mined(rows: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, default: str | None = "allow") -> list[Mined]:
    """Association rules by FP-growth, at a support that rises where tokens have many combinations; ``every_rule`` has them all."""
    baskets = baskets_of(rows)
    n = baskets.count()
    if not n or rows.where(F.col("label").isNotNull()).isEmpty():
        return []
    return fp_rules(baskets, bounded_support(baskets, min_support, n), min_confidence, default)


def every_rule(rows: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, default: str | None = "allow") -> list[Mined]:
    """All association rules at that very support from rows of ``tokens`` and ``label`` (null: unknown), without those of the label ``default``."""
    baskets = baskets_of(rows)
    n = baskets.count()
    if not n or rows.where(F.col("label").isNotNull()).isEmpty():
        return []
    if bounded_support(baskets, min_support, n) <= min_support:
        return fp_rules(baskets, min_support, min_confidence, default)
    return grown(rows, n, min_support, min_confidence, default)


def grown(rows: DataFrame, n: int, min_support: float, min_confidence: float, default: str | None) -> list[Mined]:
    """The pruned rules, by pattern growth from rare tokens to common ones, many sets a pass over all URLs.

    A set is not extended if it is a rule (what contains it would be pruned), if
    too few URLs of the label hold it, if it holds for the same URLs as its
    prefix, or if no extension can be sure enough: of the URLs of other labels
    or none, those with the set and all tokens that may follow remain in any
    extension, and those of the label only become fewer.
    """
    least = math.ceil(min_support * n)
    plain = rows.select(F.filter(F.array_distinct("tokens"), lambda x: x.isNotNull() & ~x.startswith(LABEL)).alias("tokens"), "label")
    labels = {r["label"]: r["count"] for r in plain.where(F.col("label").isNotNull()).groupBy("label").count().where(F.col("count") >= least).collect() if r["label"] != default}
    counted = plain.where(F.col("label").isin(*labels)).select(F.explode("tokens").alias("token"), "label").groupBy("token", "label").count()
    frequent = sorted((r["count"], r["token"], r["label"]) for r in counted.where(F.col("count") >= least).collect())
    names, kinds = sorted({token for _, token, _ in frequent}), sorted(labels)
    code, kind = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(kinds)}
    if not names:
        return []

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [[code[t] for t in tokens or () if t in code] for tokens in batch.column(0).to_pylist()]
            own = [kind.get(x, -1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.list_(pa.int32())), pa.array(own, pa.int32())], ["codes", "kind"])

    table = written(plain.mapInArrow(coded, "codes array<int>, kind int").where(F.size("codes") > 0), "urls")

    def sure(label: int, own: int, every: int) -> bool:
        return own / every >= min_confidence and own / every / (labels[kinds[label]] / n) > 1

    rules: list[Mined] = []
    todo = [Group(i, (), labels[label], n, [code[t] for _, t, x in frequent if x == label]) for i, label in enumerate(kinds)]
    while todo:
        now, size = [], 0
        while todo and (not now or size + len(todo[-1].tokens) <= A_PASS):
            now.append(todo.pop())
            size += len(now[-1].tokens)
        counts, at = group_counts(table, now, len(names), len(kinds), size), 0
        for group in now:
            live = []
            for token, (own, every, rest) in zip(group.tokens, counts[at : at + len(group.tokens)].tolist()):
                if own >= least and sure(group.label, own, every):
                    tokens = tuple(sorted(names[t] for t in (*group.prefix, token)))
                    rules.append(Mined(tokens, kinds[group.label], own / every, own / n))
                elif own >= least and (own, every) != (group.own, group.every):
                    live.append((own, every, rest, token))
            at += len(group.tokens)
            for i, (own, every, rest, token) in enumerate(live[:-1]):
                if sure(group.label, own, own + rest):
                    todo.append(Group(group.label, (*group.prefix, token), own, every, [x[3] for x in sorted(live[i + 1 :])]))
    dropped(table)
    return pruned(rules, default)


def group_counts(table: DataFrame, groups: list[Group], tokens: int, kinds: int, size: int) -> np.ndarray:
    """For every set of the groups: URLs of the label that hold it, URLs that hold it, and those of other labels that hold it with all later tokens of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, step = np.zeros((size, 3), np.int64), max(64, CELLS // (tokens + kinds) // 64 * 64)
        for batch in batches:
            for begun in range(0, len(batch), step):
                part = batch.slice(begun, step)
                lists, own = part.column(0), part.column(1).to_numpy()
                width = -(-len(part) // 64) * 64
                bits = np.zeros((tokens + kinds, width), bool)
                bits[lists.flatten().to_numpy(), np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())] = True
                known = np.flatnonzero(own >= 0)
                bits[tokens + own[known], known] = True
                words, at = np.packbits(bits, axis=1).view(np.uint64), 0
                for group in groups:
                    held, label = words[group.tokens], words[tokens + group.label]
                    if group.prefix:
                        held &= np.bitwise_and.reduce(words[list(group.prefix)])
                    later = np.bitwise_and.accumulate(held[::-1])[::-1] & ~label
                    for k, x in enumerate((held & label, held, later)):
                        sums[at : at + len(held), k] += np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                    at += len(held)
        some = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *sums[some].T)], ["place", "own", "every", "rest"])

    out = np.zeros((size, 3), np.int64)
    total = table.mapInArrow(run, "place long, own long, every long, rest long").groupBy("place").agg(F.sum("own"), F.sum("every"), F.sum("rest"))
    for place, *found in total.collect():
        out[place] = found
    return out


def matched(urls: DataFrame, rules: list[Mined], default: str = "allow") -> DataFrame:
    """Per row of ``page_id`` and ``tokens`` the label and confidence of the surest rule that fits, else the default and 0."""
    seen = Counter(t for r in rules for t in r.tokens)
    index: dict[str, list[Mined]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (seen[t], t)), []).append(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, sure = [], []
            for tokens in batch.column(batch.schema.get_field_index("tokens")).to_pylist():
                own = set(tokens or ())
                best = max((r for t in own for r in index.get(t, ()) if own.issuperset(r.tokens)), key=lambda r: (r.confidence, r.support, r.label, r.tokens), default=None)
                label.append(best.label if best else default)
                sure.append(best.confidence if best else 0.0)
            arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "tokens"]
            names = [name for name in batch.schema.names if name != "tokens"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(label, pa.string()), pa.array(sure, pa.float64())], [*names, "label", "confidence"])

    kinds = ", ".join(f"{c} {t}" for c, t in urls.dtypes if c != "tokens")
    return urls.mapInArrow(run, f"{kinds}, label string, confidence double")


def placed(pages: DataFrame, rules: tuple[Rule, ...], id_col: str, url_col: str) -> DataFrame:
    """Every URL's host, path and tokens, with the fixed rule that fits and its verdict."""
    places = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return places.select(
        "*",
        tokens_of(F.col("host"), F.col("path")).alias("tokens"),
        rule_value(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path).alias("rule"),
        rule_value(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("fixed"),
    )


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, min_support: float = 0.01, min_confidence: float = 0.8, default: str = "allow", id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """Verdict on every URL: the fixed rule's, else that of the association rules, else the default.

    Rules of the default label count too: a surer one outdoes a rule of another.
    ``labelled`` has the columns url and label; without it, the URLs that a
    fixed rule decides are the labelled ones, and all others the contrast.
    """
    ruled = placed(pages, rules, id_col, url_col)
    if labelled is None:
        source = ruled.select("tokens", F.col("fixed").alias("label"))
    else:
        source = labelled.select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "label")
    found = matched(ruled, every_rule(source, min_support, min_confidence, None), default)
    return found.select("page_id", "host", "path", "rule", F.coalesce("fixed", "label").alias("verdict"), F.when(F.col("fixed").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"))


def measured(rows: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, folds: int = 5) -> Measured:
    """How rules mined from rows of ``tokens`` and ``label`` judge the labelled URLs of one fold that they were not mined from."""
    fold = F.pmod(F.xxhash64("tokens"), F.lit(folds)) == 0
    rules = every_rule(rows.where(~fold), min_support, min_confidence, None)
    found = matched(rows.where(fold & F.col("label").isNotNull()).select("tokens", F.col("label").alias("truth")), rules, "")
    hit = F.col("label") != ""
    return Measured(*found.agg(F.count("*"), F.count_if(hit), F.count_if(hit & (F.col("label") == F.col("truth")))).head())
