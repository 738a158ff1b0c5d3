"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Everything is column expressions and aggregations. A tree is grown from histograms: one grouped sum
of gradients by (leaf, feature, bin) per level over a bounded sample of labelled URLs. The finished
model is one expression, so judging URLs is a projection.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import least_by_hash, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labelled URLs the trees are grown on at most: those of smallest hash.
TRAINING_ROWS = 50_000
TREES, DEPTH, BINS, LEARNING_RATE = 16, 2, 16, 0.3
LEAST_WEIGHT, PENALTY = 5.0, 1.0
# A suffix's blocked share counts as this many URLs of the average share.
SUFFIX_PRIOR = 20.0
SUFFIX_LABELS = 3


class Rule(NamedTuple):
    """``rule`` is host and path prefix together, such as ``example.com/en/``."""

    rule: str
    verdict: str


def with_host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Host after the first ``://``, A-Z lower-cased, and path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return urls.withColumn("host", F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)).withColumn(
        "path", F.coalesce(path, F.lit(""))
    )


def matching_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; NULL without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        host, slash, path = r.rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -SUFFIX_LABELS)


def _occurrences(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(of), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    letters = F.array_distinct(F.split(text, ""))
    count = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")
    total = F.length(text).cast("double")
    summed = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a + count(c) * F.log2(count(c)))
    return F.when(F.length(text) > 0, F.log2(total) - summed / total).otherwise(0.0)


def lexical_features(url: str = "url") -> dict[str, Column]:
    """Features of ``url`` with ``host`` and ``path``, and of its suffix's statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.when(F.instr(text, "?") > 0, F.substr(text, F.instr(text, "?") + 1)).otherwise("")
    return {
        "url_length": F.length(text),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": _occurrences(F.col("path"), "/"),
        "host_labels": _occurrences(F.col("host"), "."),
        "host_hyphens": _occurrences(F.col("host"), "-"),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1)),
        "entropy": _entropy(text),
        "parameters": F.when(query == "", 0).otherwise(_occurrences(query, "&") + 1),
        "secure": F.startswith(text, F.lit("https:")).cast("int"),
        "suffix_share": F.col("suffix_share"),
        "suffix_count": F.log2(F.lit(1.0) + F.col("suffix_count")),
    }


FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "host_hyphens", "digit_ratio", "entropy",
    "parameters", "secure", "suffix_share", "suffix_count",
)


class Node(NamedTuple):
    """A split (``bin`` and lower to the left) or, without a feature, a leaf."""

    feature: int | None
    bin: int
    left: Node | None
    right: Node | None
    value: float


class Model(NamedTuple):
    cuts: list[list[float]]
    trees: list[Node]
    prior: float
    suffixes: DataFrame
    average: float

    def margin(self, value_of) -> Column:
        """Log-odds of being blocked; ``value_of(feature, bin)`` says whether a row goes left."""
        return sum((_tree_value(t, value_of) for t in self.trees), F.lit(self.prior))


def _tree_value(node: Node, goes_left) -> Column:
    if node.feature is None:
        return F.lit(node.value)
    return F.when(goes_left(node.feature, node.bin), _tree_value(node.left, goes_left)).otherwise(
        _tree_value(node.right, goes_left)
    )


def _smoothed(blocked: Column, count: Column, average: float) -> Column:
    return (blocked + SUFFIX_PRIOR * average) / (count + SUFFIX_PRIOR)


def _suffix_statistics(labelled: DataFrame, average: float, *keys: str) -> DataFrame:
    return labelled.groupBy("suffix", *keys).agg(
        F.count("*").alias("suffix_count"), F.sum("blocked").alias("suffix_blocked")
    ).withColumn("suffix_share", _smoothed(F.col("suffix_blocked"), F.col("suffix_count"), average)).drop("suffix_blocked")


def _with_suffix_statistics(urls: DataFrame, statistics: DataFrame, average: float, *keys: str) -> DataFrame:
    return (
        urls.join(statistics, ["suffix", *keys], "left")
        .withColumn("suffix_count", F.coalesce("suffix_count", F.lit(0)))
        .withColumn("suffix_share", F.coalesce("suffix_share", F.lit(average)))
    )


def train(labelled: DataFrame, url: str = "url", trees: int = TREES, depth: int = DEPTH) -> Model:
    """Boosted trees for ``labelled`` (url, blocked 0 or 1).

    Rows without a url or label are left out, and a repeated row counts once. Suffix statistics are
    taken over all labelled rows; the trees are grown on at most ``TRAINING_ROWS`` of them. A training
    row's own suffix statistics come from the other half of the rows, so that a label does not
    explain itself. Without labelled rows the model has no trees and a share of one half.
    """
    rows = labelled.select(F.col(url).alias("url"), F.col("blocked").cast("int").alias("blocked"))
    rows = with_host_and_path(rows.where("url IS NOT NULL AND blocked IN (0, 1)").distinct())
    half = F.pmod(F.xxhash64("url"), F.lit(2))
    rows = stored(rows.withColumn("suffix", suffix_of(F.col("host"))).withColumn("half", half), "labelled-urls")
    average = rows.agg(F.avg("blocked")).first()[0]
    average = 0.5 if average is None else float(average)
    suffixes = stored(_suffix_statistics(rows, average), "url-suffixes")
    other = _suffix_statistics(rows, average, "half").withColumn("half", 1 - F.col("half"))
    sample = least_by_hash(rows, TRAINING_ROWS, "url", "blocked")
    features = lexical_features()
    sample = stored(
        _with_suffix_statistics(sample, other, average, "half")
        .select("blocked", *(features[name].cast("double").alias(name) for name in FEATURES)),
        "url-sample",
    )
    shares = [i / BINS for i in range(1, BINS)]
    quantiles = sample.agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in FEATURES)).first()
    cuts = [sorted(set(quantiles[n] or ())) for n in FEATURES]
    clipped = min(max(average, 0.01), 0.99)
    model = Model(cuts, [], math.log(clipped / (1 - clipped)), suffixes, average)
    bins = [sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[i]), F.lit(0)) for i, n in enumerate(FEATURES)]
    binned = stored(sample.select("blocked", F.array(*bins).alias("bins")), "url-bins")
    for _ in range(trees):
        tree = _grow(binned, model, depth)
        if tree.feature is None:
            break
        model.trees.append(tree)
    return model


def _in_bins(feature: int, bin_: int) -> Column:
    return F.col("bins")[feature] <= bin_


def _grow(binned: DataFrame, model: Model, depth: int) -> Node:
    """One tree: per level, one grouped sum over the sample by leaf, feature and bin (a bounded number of rows)."""
    share = 1 / (1 + F.exp(-model.margin(_in_bins)))
    rows = binned.select("bins", (share - F.col("blocked")).alias("slope"), (share * (1 - share)).alias("weight"))
    splits: dict[int, tuple[int, int]] = {}
    values: dict[int, float] = {}
    for level in range(depth):
        # Leaves are numbered as in a heap; a row's number follows from the splits above it.
        def leaf(node: int) -> Column:
            split = splits.get(node)
            if split is None:
                return F.lit(node)
            return F.when(_in_bins(*split), leaf(2 * node)).otherwise(leaf(2 * node + 1))

        sums: dict[int, dict[tuple[int, int], tuple[float, float]]] = {}
        grouped = (
            rows.select(leaf(1).alias("leaf"), "slope", "weight", F.posexplode("bins").alias("feature", "bin"))
            .groupBy("leaf", "feature", "bin").agg(F.sum("slope").alias("slope"), F.sum("weight").alias("weight"))
        )
        for r in grouped.collect():
            sums.setdefault(r.leaf, {})[r.feature, r.bin] = (r.slope, r.weight)
        for node, cells in sums.items():
            if node >> level != 1:
                continue
            total = tuple(sum(v[i] for (f, _), v in cells.items() if f == 0) for i in (0, 1))
            found = _best_split(cells, total, len(model.cuts))
            if found is None:
                values.setdefault(node, _step(*total))
                continue
            splits[node], (slope, weight) = found
            values[2 * node] = _step(slope, weight)
            values[2 * node + 1] = _step(total[0] - slope, total[1] - weight)

    def built(node: int) -> Node:
        split = splits.get(node)
        if split is None:
            return Node(None, 0, None, None, values.get(node, 0.0))
        return Node(*split, built(2 * node), built(2 * node + 1), 0.0)

    return built(1)


def _step(slope: float, weight: float) -> float:
    return -LEARNING_RATE * slope / (weight + PENALTY)


def _best_split(cells, total, features: int):
    """The split of a leaf that gains most, and the sums of its left side; None if none does."""
    score = lambda slope, weight: slope * slope / (weight + PENALTY)
    best, found = 1e-6, None
    for feature in range(features):
        slope = weight = 0.0
        for bin_ in sorted(b for f, b in cells if f == feature)[:-1]:
            slope, weight = slope + cells[feature, bin_][0], weight + cells[feature, bin_][1]
            if min(weight, total[1] - weight) < LEAST_WEIGHT:
                continue
            gain = score(slope, weight) + score(total[0] - slope, total[1] - weight) - score(*total)
            if gain > best:
                best, found = gain, ((feature, bin_), (slope, weight))
    return found


def judge(urls: DataFrame, model: Model, rules: list[Rule], threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, blocked_share`` of every row of ``urls`` (key, url).

    The verdict is the longest fitting rule's, else ``block`` where the trees give a share of at least
    ``threshold``. A null or malformed url has an empty host and path, so no rule fits and the trees
    decide on its features. Repeated rows are judged each, also without a key; urls of any length are read whole,
    an empty table gives no rows, and other columns are ignored.
    """
    rows = with_host_and_path(urls.select(F.col(key).alias("key"), "url")).withColumn("suffix", suffix_of(F.col("host")))
    features = lexical_features()
    rows = _with_suffix_statistics(rows, model.suffixes, model.average)
    rows = rows.select("key", "host", "path", *(features[n].cast("double").alias(f"feature_{n}") for n in FEATURES))
    goes_left = lambda f, b: F.col(f"feature_{FEATURES[f]}") <= model.cuts[f][b] if b < len(model.cuts[f]) else F.lit(True)
    share = 1 / (1 + F.exp(-model.margin(goes_left)))
    rule, verdict = matching_rule(rules)
    return rows.select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(share >= threshold, "block").otherwise("allow")).alias("verdict"),
        share.alias("blocked_share"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, blocked``: a page carries the label of the document its path ends with; blocked if toxic or of no quality.

    A document with several labels gives a row for each; null urls, paths without such a number and labels with a
    null give none.
    """
    number = F.try_to_number(F.nullif(F.regexp_extract("path", r"/(\d{1,18})(?:\.html)?/?$", 1), F.lit("")), F.lit("9" * 18))
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        F.col("doc_id").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("blocked")
    )
    return with_host_and_path(pages.select("url")).withColumn("number", number.cast("long")).join(known, "number").select("url", "blocked")
