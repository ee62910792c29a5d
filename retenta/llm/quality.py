"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Two fixed rules reject outright (too few words, too much repetition). On top of them, each
signal of a text may reject above a cutoff, and cutoffs are chosen from labelled rows: for
each stratum, signal and cutoff of a grid, the good labelled rows above the cutoff are
counted, and the cutoff is certified if so few would be seen with probability ``delta`` at
most were its true false-rejection rate ``alpha`` (exact binomial tail, and Bonferroni over
all strata, signals and cutoffs). Each signal has an equal share of ``alpha``, so the chance
that a good text of a stratum is rejected by any signal stays below ``alpha``. Of certified
cutoffs the one that rejects most bad and fewest good rows is taken; where none is certified
or none rejects more bad than good rows, the signal rejects nothing in that stratum.

Nulls and ties: a null text has no words and fails the first rule; a null stratum is a
stratum of its own; labels of unknown documents, null labels and null ids are ignored, a
document labelled twice counts twice; repeated rows are judged each for itself and come
back each. Without labels nothing but the fixed rules rejects. Empty tables give no rows.
All columns of the input are kept apart from the signals, so their names never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retenta.llm.exprs import SPACE_RUN, WORD_CHAR, let, total, words
from retenta.session import stage

SYMBOLS = r"[#*$%&|<>]"
SPAN = 5
#: Signals that may reject above a cutoff, and the cutoffs tried for each.
GRIDS = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0],
    "dup_line_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_rate": [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18],
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
#: How many bad rows must go for each good one that goes, when a cutoff is picked among the certified.
COST_OF_GOOD = 100
#: Strata beyond this many are joined and not broadcast.
BROADCAST_STRATA = 10_000


def _repeat_words(w: Column) -> Column:
    """Words covered by windows of ``SPAN`` words that occur twice or more in the text."""

    def covered(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))

        def lengths(p: Column) -> Column:
            step = lambda x, k: F.least(F.lit(SPAN), F.coalesce(F.get(p, k + 1) - x, F.lit(SPAN)))
            return total(F.transform(p, step))

        return let(let(keyed, places), lengths)

    def hashes(v: Column) -> Column:
        return F.transform(
            F.slice(v, F.lit(1), F.greatest(F.size(v) - (SPAN - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(v, i + k) for k in range(1, SPAN)]),
        )

    none = F.lit(0).cast("long")
    return let(
        let(w, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))
    )


def signals(docs: DataFrame, id_col: str, text_col: str, stratum_col: str | None, extra: list[Column] = ()) -> DataFrame:
    """``doc_id``, ``stratum``, the counts of each text and the rates that thresholds are set on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")
    cut = docs.select(
        F.col(id_col).alias("doc_id"),
        stratum.alias("stratum"),
        *extra,
        words(F.col(text_col)).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHAR)).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
    )
    kept = [column for column in cut.columns if column not in ("w", "lines")]
    counted = cut.select(
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    rate = lambda name, of: F.col(name) / F.greatest(F.col(of), F.lit(1))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_rate": rate("n_symbols", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "word_length": rate("word_chars", "n_words"),
        }
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from k down, for k up to the mean; 1 as a bound beyond it.

    Terms more than 40 standard deviations below k are less than the last digit of the sum.
    """
    log_odds = math.log(p) - math.log1p(-p)
    n, k = n.cast("double"), k.cast("long")
    reach = F.ceil(40 * F.sqrt(n * p) + 40).cast("long")
    low = F.greatest(F.lit(0).cast("long"), k - reach)
    # log C(n, k) p^k (1-p)^(n-k), one factor at a time; then each lower term by its ratio to the one above.
    first = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        n * math.log1p(-p),
        lambda a, i: a + F.log((n - i + 1) / i) + log_odds,
    )
    down = F.aggregate(
        F.when(k > low, F.sequence(k, low + 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: let(
            a["term"] * i / (n - i + 1) * math.exp(-log_odds),
            lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")),
        ),
        lambda a: a["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first + F.log(down))))


def thresholds(scored: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row per stratum: ``cutoffs``, a map from signal to its certified cutoff.

    ``labels`` has (doc_id, good). Rows that the fixed rules reject are no evidence either way.
    """
    known = labels.filter(F.col("good").isNotNull() & F.col("doc_id").isNotNull())
    rows = known.join(scored.filter(~F.col("base_failed")), "doc_id")
    above = [
        F.sum(F.when((F.col(signal) > cutoff) & (F.col("good") == good), 1).otherwise(0)).alias(f"{kind}_{signal}_{i}")
        for signal, grid in GRIDS.items()
        for i, cutoff in enumerate(grid)
        for kind, good in (("good", True), ("bad", False))
    ]
    counts = rows.groupBy("stratum").agg(F.count(F.when(F.col("good"), 1)).alias("n_good"), *above)
    cells = [
        F.struct(
            F.lit(signal).alias("signal"),
            F.lit(cutoff).alias("cutoff"),
            F.col(f"good_{signal}_{i}").alias("good_above"),
            F.col(f"bad_{signal}_{i}").alias("bad_above"),
        )
        for signal, grid in GRIDS.items()
        for i, cutoff in enumerate(grid)
    ]
    tests = F.count("*").over(Window.partitionBy()) * len(cells)
    one = counts.select("stratum", "n_good", tests.alias("tests"), F.array(*cells).alias("cells"))
    flat = one.select("stratum", "n_good", "tests", F.inline("cells"))
    share = alpha / len(GRIDS)
    tail = binomial_tail(F.col("good_above"), F.col("n_good"), share)
    gain = F.col("bad_above") - COST_OF_GOOD * F.col("good_above")
    # More good rows above than the tolerated share can't be certified; their tail needn't be summed.
    hopeful = flat.filter((gain > 0) & (F.col("good_above") <= share * F.col("n_good")))
    certified = hopeful.filter(tail <= delta / F.col("tests"))
    best = certified.groupBy("stratum", "signal").agg(F.max_by("cutoff", F.struct(gain, "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("cutoffs"))


def judged(scored: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``scored`` with ``kept``. It is read twice, so it should be a table and not a long computation."""
    limits = stage(thresholds(scored, labels, alpha, delta), "quality-thresholds")
    limits = limits.select(F.col("stratum").alias("_stratum"), "cutoffs")
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    over = [F.coalesce(F.col(signal) > F.element_at("cutoffs", signal), F.lit(False)) for signal in GRIDS]
    rejected = over[0]
    for one in over[1:]:
        rejected = rejected | one
    joined = scored.join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", **risk: float) -> DataFrame:
    """Signals and verdict of every document, without its text."""
    return judged(stage(signals(docs, id_col, text_col, stratum_col), "quality-signals"), labels, **risk)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", **risk: float) -> DataFrame:
    """The documents that are kept, with their own columns."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row")
    scored = stage(signals(docs, id_col, text_col, stratum_col, [row]), "quality-signals")
    return judged(scored, labels, **risk).filter("kept").select("_row.*")
