"""Quality by perplexity under a character model of trusted text: interpolated modified Kneser-Ney.

A gram is four characters in one long, 16 bits each, so that contexts and shorter grams are shifts
and masks of columns. Each task counts its distinct grams; the counts of all orders, their contexts
and the probabilities are grouped sums and joins sharded by language and gram. To score, texts are
dealt into parts of bounded size; each part's distinct grams are joined with their probabilities by
language and gram, and what is found comes back to the part's texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import slices, stored

ORDER = 4
CODE_BITS = 16
# Characters of the texts that are scored together, on average; they have no more distinct grams.
PART_GRAMS = 16 << 20
# One in so many trusted documents sets the thresholds instead of training the model.
CALIBRATION_FOLDS = 5
# Of these, the share that passes.
QUANTILE = 0.99
# A text's surprise is judged as if so many characters of average surprise came with it.
PRIOR_CHARACTERS = 60.0
SLICE_BYTES = 2 << 20
SLOT_BITS = 20
UNKNOWN = "und"


def _gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character, and each text's first; a text starts after empty characters.

    Code points are folded to 16 bits, so rare characters beyond them share codes with others.
    """
    pad = ORDER - 1
    joined = "".join("\0" * pad + t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes & np.uint64(0xFFFF)) ^ (codes >> np.uint64(16))
    grams = np.zeros(max(0, len(codes) - pad), np.uint64)
    for k in range(ORDER):
        grams |= codes[k : len(codes) - pad + k] << np.uint64(CODE_BITS * (ORDER - 1 - k))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + pad) - (sizes + pad)
    # Where a text's padding ends, a gram of the text before would run on; those are cut out.
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return grams[inside], np.cumsum(sizes) - sizes


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts; most by a table of slots, the colliding rest by sorting."""
    slots = _slot(grams)
    table = np.zeros(1 << SLOT_BITS, np.uint64)
    table[slots] = grams
    own = table[slots] == grams
    counts = np.bincount(slots[own], minlength=len(table))
    used = np.flatnonzero(counts)
    rest, times = np.unique(grams[~own], return_counts=True)
    return np.concatenate((table[used], rest)), np.concatenate((counts[used], times))


def _by_language(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    langs = np.array(rows.column("lang").to_pylist(), object)
    for lang in sorted(set(langs.tolist())):
        yield lang, np.flatnonzero(langs == lang)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of a task by language: occurrences in the training texts, 0 if only in others."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for lang, at in _by_language(rows):
                for trained in (True, False):
                    grams, _ = _gram_codes([texts[i] for i in at.tolist() if train[i] == trained])
                    new, counts = _distinct(grams)
                    old = held.get(lang, (new[:0], counts[:0]))
                    both = np.concatenate((old[0], new))
                    grams, place = np.unique(both, return_inverse=True)
                    held[lang] = grams, np.bincount(place, np.concatenate((old[1], counts * trained)), len(grams)).astype(np.int64)
    for lang, (grams, counts) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "count"]
        )


def _shorter(gram: Column, order: int) -> Column:
    """The last ``order`` characters."""
    return gram.bitwiseAND(F.lit((1 << (CODE_BITS * order)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, CODE_BITS)


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language the discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    times = [F.sum((F.col("count") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    share = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    estimate = lambda k: F.least(F.greatest(
        F.lit(0.05), k - (k + 1) * share * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0))
    ), F.lit(float(k) - 0.05))
    return counts.groupBy("lang").agg(*times).select("lang", *(estimate(k).alias(f"d{k}") for k in (1, 2, 3)))


def _discount(count: Column) -> Column:
    return F.when(count == 1, F.col("d1")).when(count == 2, F.col("d2")).otherwise(F.col("d3"))


def _order_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discounted counts of the grams, and of each context its total and the weight left to shorter grams."""
    grams = counts.join(_discounts(counts), "lang")
    contexts = grams.groupBy("lang", _context(F.col("gram")).alias("context")).agg(
        F.sum("count").alias("total"), F.sum(_discount(F.col("count"))).alias("left_over")
    )
    return grams.select("lang", "gram", (F.col("count") - _discount(F.col("count"))).alias("kept")), contexts


def log_probabilities(counted: DataFrame) -> DataFrame:
    """``lang, gram, log_p`` of every row of ``counted`` (lang, gram, count of the training texts).

    A language without training text gives every character the probability 1.
    """
    training = counted.where("count > 0").select("lang", "gram", "count")
    asked = counted.select("lang", "gram")
    of_order = {ORDER: training}
    wanted = {ORDER: asked}
    for order in range(ORDER - 1, 0, -1):
        # A shorter gram counts by the distinct characters it comes after.
        of_order[order] = of_order[order + 1].groupBy("lang", _shorter(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("count"))
        wanted[order] = wanted[order + 1].select("lang", _shorter(F.col("gram"), order).alias("gram")).distinct()
    letters = of_order[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))
    known = wanted[1].join(letters, "lang", "left").select("lang", "gram", F.coalesce("p", F.lit(1.0)).alias("p"))
    for order in range(1, ORDER + 1):
        if order > 1:
            known = wanted[order].withColumn("shorter", _shorter(F.col("gram"), order - 1)).join(
                known.withColumnRenamed("gram", "shorter"), ["lang", "shorter"]
            ).drop("shorter")
        grams, contexts = _order_tables(of_order[order])
        joined = known.withColumn("context", _context(F.col("gram"))).join(grams, ["lang", "gram"], "left").join(
            contexts, ["lang", "context"], "left"
        )
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(
            (F.coalesce("kept", F.lit(0.0)) + F.col("left_over") * F.col("p")) / F.col("total")
        )
        known = stored(joined.select("lang", "gram", p.alias("p")), f"gram-probabilities-{order}")
    return known.select("lang", "gram", F.log("p").alias("log_p"))


class _Lookup:
    """Log-probabilities by gram: a table of slots, and a sorted array for what collides there."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, self.values = grams[order], values[order]
        self.table = np.full(1 << SLOT_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(1 << SLOT_BITS, np.float32)
        slots = _slot(self.grams)
        self.table[slots] = self.grams
        self.value[slots] = self.values

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        slots = _slot(grams)
        found = self.value[slots]
        missed = np.flatnonzero(self.table[slots] != grams)
        at = np.minimum(np.searchsorted(self.grams, grams[missed]), max(0, len(self.grams) - 1))
        found[missed] = np.where(self.grams[at] == grams[missed], self.values[at], 0) if len(self.grams) else 0
        return found


def _asked(rows: pa.Table) -> pa.Table:
    """Distinct grams of one part's texts by language."""
    held: dict[str, np.ndarray] = {}
    for batch in rows.to_batches():
        for own in slices(batch, "text", SLICE_BYTES):
            texts = [t or "" for t in own.column("text").to_pylist()]
            for lang, at in _by_language(own):
                grams, _ = _distinct(_gram_codes([texts[i] for i in at.tolist()])[0])
                held[lang] = np.union1d(held.get(lang, grams[:0]), grams)
    sizes = [len(grams) for grams in held.values()]
    langs = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
    grams = np.concatenate(list(held.values())).view(np.int64)
    return pa.table({"part": pa.repeat(rows.column("part")[0], len(grams)), "lang": langs, "gram": grams})


def _summed(rows: pa.Table, known: pa.Table) -> pa.Table:
    """``doc_id, lang, n_chars, log_p`` of one part's texts from the probabilities of its grams."""
    found = np.zeros(rows.num_rows)
    for lang, at in _by_language(rows):
        own = known.filter(pc.equal(known.column("lang"), lang))
        lookup = _Lookup(own.column("gram").to_numpy().view(np.uint64), own.column("log_p").to_numpy())
        done = 0
        for batch in rows.select(["text"]).take(pa.array(at)).to_batches():
            for some in slices(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in some.column("text").to_pylist()]
                row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                grams, _ = _gram_codes(texts)
                found[at[done : done + len(texts)]] = np.bincount(row, lookup(grams), minlength=len(texts))
                done += len(texts)
    return pa.table({**{n: rows.column(n) for n in ("doc_id", "lang", "n_chars")}, "log_p": found})


def score(docs: DataFrame, log_p: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """``doc_id, lang, n_chars, log_p``: the summed log-probability of every row's whole text."""
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text", n_chars.alias("n_chars"))
    parts = max(1, -(-(rows.agg(F.sum("n_chars")).first()[0] or 0) // part_grams))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    # Both groupings of the texts are one exchange of the plan.
    asked = rows.groupBy("part").applyInArrow(_asked, "part int, lang string, gram bigint")
    known = asked.join(log_p.select("lang", "gram", F.col("log_p").cast("float")).hint("merge"), ["lang", "gram"])
    return rows.groupBy("part").cogroup(known.select("part", "lang", "gram", "log_p").groupBy("part")).applyInArrow(
        _summed, rows.select("doc_id", "lang", "n_chars").schema.add("log_p", "double")
    )


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, keep`` of every row of ``docs`` (doc_id, text, lang).

    ``trusted`` (doc_id) names the documents whose text trains the model; one in ``CALIBRATION_FOLDS``
    of them, by hash, sets its language's threshold instead: the ``quantile`` of their surprise. A
    document is kept if its mean surprise, with ``PRIOR_CHARACTERS`` of its language's average, is at
    most that. A null or empty text has no perplexity and is not kept; a language without a threshold
    keeps all its texts. A null language is one of its own. Repeated rows are judged each; other
    columns are ignored.
    """
    ids = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_FOLDS))
    texts = docs.select("doc_id", "text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    # One plan at any size: the flags are not broadcast while they happen to be few.
    flagged = texts.join(ids.withColumn("train", fold > 0).hint("merge"), "doc_id", "left")
    counted = flagged.select("text", "lang", F.coalesce("train", F.lit(False)).alias("train")).mapInArrow(
        _counted, "lang string, gram bigint, count bigint"
    )
    grams = stored(counted.groupBy("lang", "gram").agg(F.sum("count").alias("count")), "grams")
    scored = stored(score(texts, log_probabilities(grams)), "log-probabilities")
    calibration = scored.where("n_chars > 0").join(ids.where(fold == 0), "doc_id", "left_semi")
    average = calibration.groupBy("lang").agg((F.sum(-F.col("log_p")) / F.sum("n_chars")).alias("average"))
    surprise = (F.coalesce("average", F.lit(0.0)) * PRIOR_CHARACTERS - F.col("log_p")) / (F.col("n_chars") + PRIOR_CHARACTERS)
    limits = calibration.join(average, "lang").groupBy("lang", "average").agg(
        F.percentile_approx(surprise, quantile, 10_000).alias("limit")
    )
    limits = stored(limits, "perplexity-limits")
    return scored.join(limits, "lang", "left").select(
        "doc_id", "lang", "n_chars",
        F.when(F.col("n_chars") > 0, F.exp(-F.col("log_p") / F.col("n_chars"))).alias("perplexity"),
        F.exp("limit").alias("threshold"),
        ((F.col("n_chars") > 0) & F.coalesce(surprise <= F.col("limit"), F.lit(True))).alias("keep"),
    )
