"""Monitoring over the decision table.

All metrics are grouped aggregates; nothing iterates rows on the driver.
Quantiles and rank-based AUC work on exact scores, ranked range by range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import write_table

# PSI bins and status cut-offs, fairness ratio, risk tiers.
PSI_BINS = 10
PSI_CLIP = 1e-4
PSI_STABLE = 0.1
PSI_MODERATE = 0.2
ADVERSE_IMPACT_RATIO = 0.8
RISK_TIER_LOW = 0.20
RISK_TIER_MEDIUM = 0.40

APPROVED = ("APPROVE", "MANUAL_REVIEW")


def dbl_(c: Column) -> Column:
    return c.cast("double")


def _approved(c: Column) -> Column:
    return c.isin(*APPROVED)


# --------------------------------------------------------------------------- W3-W7, W10
def portfolio_metrics(decisions: DataFrame) -> DataFrame:
    """One row; an empty input yields the error record."""
    d = F.col("decision")
    amt = F.col("max_amount_eur") if "max_amount_eur" in decisions.columns else F.col("max_amount")
    agg = decisions.agg(
        F.count(F.lit(1)).alias("total_applications"),
        F.count(F.when(_approved(d), F.lit(1))).alias("n_approved"),
        F.count(F.when(d == "DECLINE", F.lit(1))).alias("n_declined"),
        F.avg(F.when(_approved(d), amt.cast("double"))).alias("avg_amt"))
    tot = F.col("total_applications")
    return agg.select(
        "total_applications",
        F.when(tot > 0, F.round(F.col("n_approved") / tot, 3)).alias("approval_rate"),
        F.when(tot > 0, F.round(F.col("n_declined") / tot, 3)).alias("decline_rate"),
        F.when(tot > 0, F.coalesce(F.round("avg_amt", 2), F.lit(0.0))).alias("avg_approved_amount"),
        # Fixed value: the text for no decisions.
        F.when(tot == 0, F.lit("No decisions to analyze")).alias("error"))


def pricing_distribution(decisions: DataFrame) -> DataFrame:
    """Pricing band counts among non-declined decisions (NULL bands dropped)."""
    return (decisions.filter(_approved(F.col("decision")) & F.col("pricing_band").isNotNull())
            .groupBy("pricing_band").agg(F.count(F.lit(1)).alias("n")))


def decline_reasons(decisions: DataFrame, codes_col: str = "reason_codes") -> DataFrame:
    """Reason-code counts over DECLINE decisions; accepts array or JSON text."""
    dtype = dict(decisions.dtypes)[codes_col]
    codes = F.col(codes_col) if dtype.startswith("array") else F.from_json(F.col(codes_col), "array<string>")
    return (decisions.filter(F.col("decision") == "DECLINE").select(F.explode(codes).alias("reason_code"))
            .groupBy("reason_code").agg(F.count(F.lit(1)).alias("n")))


def score_by_decision(decisions: DataFrame, score_col: str = "shadow_ml_score") -> DataFrame:
    """Mean shadow score per decision, 4 dp."""
    return decisions.groupBy("decision").agg(F.round(F.avg(score_col), 4).alias("avg_shadow_score"))


def run_summary(decisions: DataFrame, score_col: str | None = "shadow_ml_score") -> DataFrame:
    """Decision counts plus APPROVE-only amount, band counts and mean score (one row)."""
    d = F.col("decision")
    amt = F.col("max_amount_eur") if "max_amount_eur" in decisions.columns else F.col("max_amount")
    appr = d == "APPROVE"
    cols = [F.count(F.when(d == k, F.lit(1))).alias(f"n_{k.lower()}") for k in ("APPROVE", "MANUAL_REVIEW", "DECLINE")]
    cols += [F.avg(F.when(appr, amt.cast("double"))).alias("approve_avg_amount")]
    cols += [F.count(F.when(appr & (F.col("pricing_band") == b), F.lit(1))).alias(f"approve_band_{b}")
             for b in ("A", "B", "C")]
    if score_col:
        cols.append(F.avg(F.when(appr, F.col(score_col))).alias("approve_avg_score"))
    return decisions.agg(*cols)


# --------------------------------------------------------------------------- W8-W9 fairness
def adverse_impact(decisions: DataFrame, merchants: DataFrame, by: str,
                   score_col: str | None = "shadow_ml_score", flag: bool = True) -> DataFrame:
    """W8 (by='sector', with flag) and W9 (by='n_psps', no flag).

    The merchant attribute is looked up by a left join on merchant_id (the
    merchant table is keyed, one row per merchant); the overall rate is a sum
    over the small grouped table."""
    m = merchants.select("merchant_id", by).dropDuplicates(["merchant_id"])
    j = decisions.join(m, "merchant_id", "left").filter(F.col(by).isNotNull())
    d = F.col("decision")
    aggs = [F.count(d).alias("total"),
            F.count(F.when(_approved(d), F.lit(1))).alias("approved")]
    if flag:
        aggs.append(F.count(F.when(d == "DECLINE", F.lit(1))).alias("declined"))
        if score_col:
            aggs.append(F.avg(score_col).alias("avg_ml_score"))
    g = j.groupBy(by).agg(*aggs).withColumn("approval_rate", F.round(F.try_divide(dbl_(F.col("approved")), dbl_(F.col("total"))), 3))
    if flag:
        everything = Window.partitionBy()  # over the grouped table: one row per sector
        overall = F.try_divide(dbl_(F.sum("approved").over(everything)), dbl_(F.sum("total").over(everything)))
        g = g.withColumn("flag", F.when(F.col("approval_rate") < overall * ADVERSE_IMPACT_RATIO, "REVIEW")
                         .otherwise("OK"))
    return g


# --------------------------------------------------------------------------- W11, W12, L5, L6, L10
def _ranked(scored: DataFrame, score_col: str, label_col: str | None, by: list[str]) -> DataFrame:
    """Distinct exact scores s per group, with their rows c, the rows of lower scores (below) and of the group (n).

    Rows are counted by exact score and dealt into ranges of (group, score) that
    Spark samples, so that the ranges are even wherever the scores lie. The
    ranges are written, as another sample would cut elsewhere. Inside a range a
    window ranks its own scores; the counts of the ranges before it, one row per
    group and range, carry the ranks over."""
    s = F.col(score_col).cast("double")
    known = s.isNotNull() & ~F.isnan(s)
    aggs = [F.count(F.lit(1)).alias("c")]
    if label_col:
        y = F.col(label_col).cast("int")
        known = known & y.isNotNull()
        aggs += [F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")]
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hist = (scored.filter(known).groupBy(*by, s.alias("s")).agg(*aggs).repartitionByRange(ranges, *by, "s")
            .withColumn("_range", F.spark_partition_id()))
    hist = write_table(hist, "score-ranges")
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (hist.groupBy(*by, "_range").agg(F.sum("c").alias("_c"))
             .select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_range").alias("_of"),
                     F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("n")))
    inside = Window.partitionBy("_range", *by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_of")
    for b in by:  # a group without a name is a group
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return (hist.join(sizes, same).drop("_of", *[f"_by_{b}" for b in by])
            .withColumn("below", F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))))


def score_quartiles(scored: DataFrame, by: str = "decision", score_col: str = "shadow_ml_score") -> DataFrame:
    """Mean and exact quartiles (linear interpolation) of the score per group."""
    h = _ranked(scored, score_col, None, [by])
    aggs = [F.sum(F.col("s") * F.col("c")).alias("_sum"), F.max("n").alias("n")]
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        pos = (F.col("n") - 1).cast("double") * p
        covers = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("c"))
        aggs += [F.max(F.when(covers(F.floor(pos)), F.col("s"))).alias(f"{name}_lo"),
                 F.max(F.when(covers(F.ceil(pos)), F.col("s"))).alias(f"{name}_hi"),
                 F.max(pos - F.floor(pos)).alias(f"{name}_f")]
    g = h.groupBy(by).agg(*aggs)
    out = [F.col(by), F.col("n").alias("n"), F.round(F.col("_sum") / F.col("n"), 6).alias("mean_score")]
    for name in ("q25", "q50", "q75"):
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append(F.round(lo + F.col(f"{name}_f") * (hi - lo), 6).alias(name))
    return g.select(*out)


def auc_brier(scored: DataFrame, score_col: str, label_col: str, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC with average ranks for ties, Brier score and positive rate of exact scores.

    AUC = (sum of average ranks of positives - P(P+1)/2) / (P * N). All figures
    come from one table of distinct scores; rows without score or label do not count."""
    by = by or []
    h = _ranked(scored, score_col, label_col, by)
    rank = F.col("below") + (F.col("c") + 1) / 2.0  # average rank of the tied block [below + 1, below + c]
    s = F.col("s")
    g = h.groupBy(*by).agg(F.sum(F.col("pos") * rank).alias("_ranks"), F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                           F.sum(F.col("pos") * (1 - s) * (1 - s) + F.col("neg") * s * s).alias("_squares"))
    auc = F.try_divide(F.col("_ranks") - F.col("P") * (F.col("P") + 1) / 2.0, dbl_(F.col("P") * F.col("N")))
    both = dbl_(F.col("P") + F.col("N"))
    return g.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0), F.round(auc, 6)).alias("auc"), "P", "N",
                    F.round(F.try_divide(F.col("_squares"), both), 6).alias("brier"),
                    F.round(F.try_divide(dbl_(F.col("P")), both), 6).alias("default_rate"))


def risk_tier(score: Column) -> Column:
    """Low < 0.20 <= medium < 0.40 <= high; no score has no tier."""
    return (F.when(score.isNull() | F.isnan(score.cast("double")), F.lit(None).cast("string"))
            .when(score < RISK_TIER_LOW, "low").when(score < RISK_TIER_MEDIUM, "medium").otherwise("high"))


# --------------------------------------------------------------------------- W1, W2 drift
def psi_from_long(long_ref: DataFrame, long_cur: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """W1/W2 over long tables (feature, value): equal-width bins over the union
    range per feature, last bin closed, shares clipped at 1e-4, PSI rounded to 4 dp."""
    ref = long_ref.select("feature", F.col("value").cast("double").alias("value"), F.lit("e").alias("side"))
    cur = long_cur.select("feature", F.col("value").cast("double").alias("value"), F.lit("a").alias("side"))
    both = ref.unionByName(cur).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = both.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                      F.count(F.when(F.col("side") == "e", 1)).alias("n_e"),
                                      F.count(F.when(F.col("side") == "a", 1)).alias("n_a"))
    # one row per feature: a keyed table bounded by the number of features
    j = both.join(F.broadcast(rng), "feature")
    step = (F.col("hi") - F.col("lo")) / bins
    edges_below = reduce(lambda a, b: a + b,
                         [F.when(F.col("value") >= F.col("lo") + k * step, 1).otherwise(0) for k in range(bins + 1)])
    binned = j.select("feature", "side", F.least(F.lit(bins), edges_below).alias("bin"))
    counts = binned.groupBy("feature", "bin").agg(F.count(F.when(F.col("side") == "e", 1)).alias("ce"),
                                                  F.count(F.when(F.col("side") == "a", 1)).alias("ca"))
    spine = rng.select("feature", "n_e", "n_a", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    full = spine.join(counts, ["feature", "bin"], "left")
    e = F.greatest(F.try_divide(dbl_(F.coalesce(F.col("ce"), F.lit(0))), dbl_(F.col("n_e"))), F.lit(PSI_CLIP))
    a = F.greatest(F.try_divide(dbl_(F.coalesce(F.col("ca"), F.lit(0))), dbl_(F.col("n_a"))), F.lit(PSI_CLIP))
    psi = full.groupBy("feature").agg(F.round(F.sum((a - e) * F.log(a / e)), 4).alias("psi"))
    return psi.withColumn("status", F.when(F.col("psi") < PSI_STABLE, "stable")
                          .when(F.col("psi") < PSI_MODERATE, "moderate_shift").otherwise("significant_drift"))


def unpivot(df: DataFrame, columns: list[str], key: str = "feature", value: str = "value") -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value))
                                         for c in columns])).alias("_kv")).select("_kv.*")


def drift_report(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """PSI for every feature present in both tables, one grouped job."""
    shared = [f for f in features if f in reference.columns and f in current.columns]
    return psi_from_long(unpivot(reference, shared), unpivot(current, shared))
