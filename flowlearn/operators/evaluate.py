"""Confusion counts, metrics and threshold calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flow import ratio

#: Ranges of the score that the sweep sums on their own.
RANGES = 64


def confusion(df: DataFrame, truth: str, predicted: str, positive=1, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp."""
    t, p = F.col(truth) == F.lit(positive), F.col(predicted) == F.lit(positive)
    return df.groupBy(*(by or [])).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def metrics(counts: DataFrame) -> DataFrame:
    """The five metrics of confusion counts; 0 where a metric has no cases, an error for no rows."""
    c = {n: F.col(n) for n in ("tn", "fp", "fn", "tp")}
    total = c["tn"] + c["fp"] + c["fn"] + c["tp"]
    p, r = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    return counts.select(
        *[x for x in counts.columns],
        F.when(total > 0, (c["tp"] + c["tn"]) / total).otherwise(F.raise_error(F.lit("empty confusion matrix")).cast("double")).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        ratio(c["tn"], c["tn"] + c["fp"]).alias("specificity"),
        ratio(2 * p * r, p + r).alias("f1"),
    )


def long_form(row: DataFrame, names: tuple[str, ...] = ("accuracy", "precision", "recall", "specificity", "f1")) -> DataFrame:
    """``metric`` and ``value``."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")


def confusion_table(counts: DataFrame) -> DataFrame:
    """``actual``, ``predicted_benign`` and ``predicted_malicious``."""
    row = lambda name, a, b: F.struct(F.lit(name).alias("actual"), F.col(a).alias("predicted_benign"), F.col(b).alias("predicted_malicious"))
    return counts.select(F.explode(F.array(row("benign", "tn", "fp"), row("malicious", "fn", "tp"))).alias("r")).select("r.*")


def scores(df: DataFrame, truth: str, predicted: str, positive=None, order: str | None = None) -> dict[str, float]:
    """accuracy, precision, recall and f1 of any labels. By default 1 is positive if it occurs,
    else the first label in ``order``."""
    t = F.col(truth)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t.cast("string") == "1").alias("ones"), (F.min_by(t, F.col(order)) if order else F.min(t)).alias("first")).first()
    if not found.n:
        raise ValueError("there are no labels")
    pos = positive if positive is not None else ("1" if isinstance(found.first, str) else 1) if found.ones else found.first
    hit, said = t == F.lit(pos), F.col(predicted) == F.lit(pos)
    c = df.agg(F.count_if(t == F.col(predicted)).alias("right"), F.count_if(hit).alias("pos"), F.count_if(said).alias("said"), F.count_if(hit & said).alias("tp")).first()
    if not c.pos:
        raise ValueError("the positive label doesn't occur")
    p, r = (c.tp / c.said if c.said else 0.0), c.tp / c.pos
    return {"accuracy": c.right / found.n, "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def sweep(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """Confusion counts for each distinct score as a threshold (at least that is positive).

    Equal scores are counted first. Running sums are taken within ranges of the score, cut at
    its quantiles, to which the sums of the higher ranges, a few rows, are added: no task sees
    all scores.
    """
    hit = F.col(label) == F.lit(positive)
    grouped = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(hit).alias("t"), F.count_if(~hit).alias("f"))
    cuts = sorted(set(grouped.agg(F.percentile_approx("threshold", [i / RANGES for i in range(1, RANGES)], 1000).alias("q")).first().q or []))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("threshold"))) if cuts else F.lit(0)
    ranged = grouped.withColumn("part", part)
    sums = ranged.groupBy("part").agg(F.sum("t").alias("st"), F.sum("f").alias("sf"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # over at most RANGES rows
    whole = Window.partitionBy()
    bases = sums.select("part", *[F.coalesce(F.sum(f"s{k}").over(above), F.lit(0)).alias(f"b{k}") for k in "tf"], *[F.sum(f"s{k}").over(whole).alias(f"all_{k}") for k in "tf"])
    run = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(bases), "part").select("threshold", (F.sum("t").over(run) + F.col("bt")).alias("tp"), (F.sum("f").over(run) + F.col("bf")).alias("fp"), "all_t", "all_f")
    return out.select("threshold", (F.col("all_f") - F.col("fp")).alias("tn"), "fp", (F.col("all_t") - F.col("tp")).alias("fn"), "tp")


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "threshold", ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), "tn", "fp", "fn", "tp",
    )


def best_threshold(df: DataFrame, score: str, label: str, positive=1, minimum_recall: float | None = None, minimum_specificity: float | None = None) -> DataFrame:
    """One row: the threshold of the greatest F1 among those that meet the minima, the highest of
    equals, with its metrics and counts; no row if none does."""
    for name, m in (("minimum_recall", minimum_recall), ("minimum_specificity", minimum_specificity)):
        if m is not None and not 0 <= m <= 1:
            raise ValueError(f"{name} must lie between zero and one")
    ok: Column = F.lit(True)
    if minimum_recall is not None:
        ok = ok & (F.col("recall") >= minimum_recall)
    if minimum_specificity is not None:
        ok = ok & (F.col("specificity") >= minimum_specificity)
    return rates(sweep(df, score, label, positive)).where(ok).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def optimal_f1_threshold(df: DataFrame, score: str, label: str, positive=1, **minima) -> dict[str, float]:
    """``best_threshold`` as values. ValueError for no rows, scores that aren't finite, labels
    that aren't exactly two with the positive among them, or minima that nothing meets."""
    s = F.col(score).cast("double")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad"), F.count_if(F.col(label) == F.lit(positive)).alias("pos"), F.count_distinct(label).alias("labels")).first()
    for wrong, what in ((not seen.n, "there are no scores"), (seen.bad, "scores must be finite"), (not seen.pos, "the positive label doesn't occur"), (seen.labels != 2, "exactly two labels are needed")):
        if wrong:
            raise ValueError(what)
    found = best_threshold(df, score, label, positive, **minima).first()
    if found is None:
        raise ValueError("no threshold meets the minima")
    return found.asDict()
