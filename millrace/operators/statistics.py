"""Process statistics: proportions, trends, control charts, comparisons and text counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .running import running_sums, with_ties


def normal_cdf(z: Column) -> Column:
    """Phi by the error-function polynomial 7.1.26 of Abramowitz and Stegun (fixed coefficients)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def proportion_interval(df: DataFrame, hits: str, total: str, z: float = 1.96) -> DataFrame:
    p, n = F.col(hits) / F.col(total), F.col(total)
    half = F.when((p <= 0) | (p >= 1), z * F.sqrt(1 / (4 * n))).otherwise(z * F.sqrt(p * (1 - p) / n))
    return df.withColumns({"rate": F.round(p, 6), "ci_low": F.round(F.greatest(p - half, F.lit(0.0)), 6), "ci_high": F.round(F.least(p + half, F.lit(1.0)), 6)})


def daily_significance(days: DataFrame, hits: str, total: str, alpha: float = 0.05) -> DataFrame:
    """Each day's rate against the overall rate of its series by a one-sample z test."""
    overall = days.groupBy("series").agg((F.sum(hits) / F.sum(total)).alias("p0"))
    rows = days.join(overall, "series")
    se = F.sqrt(F.col("p0") * (1 - F.col("p0")) / F.col(total))
    z = F.when(se > 0, (F.col(hits) / F.col(total) - F.col("p0")) / se).otherwise(0.0)
    p = F.when(se > 0, 2 * (1 - normal_cdf(F.abs(z)))).otherwise(1.0)
    return rows.select("series", "day", hits, total, F.round(z, 4).alias("z"), F.round(p, 4).alias("p_value"), (p < alpha).alias("significant"))


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the regularized incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * fraction(1 - x, b, a) / b
    return front * fraction(x, a, b) / a


def fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function, from its tail: 200 terms are far beyond convergence here."""
    value = 0.0
    for k in range(200, 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = d / (1 + value)
    return 1 / (1 + value)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """One row per series, so what runs in Python here stays small."""
    return pd.Series([None if pd.isna(x) or n <= 0 else t_tail(abs(x), n) for x, n in zip(t, df)], dtype="float64")


def linear_trend(days: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, r squared, the t statistic with n - 2 degrees of freedom and its two-sided p-value, for each series."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    out = days.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_r2(a, b).alias("r2"))
    t = F.when((F.col("n") > 2) & (F.col("r2") < 1), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    p = t_p_value(F.col("t"), (F.col("n") - 2).cast("double"))
    return out.withColumn("t", t).select("series", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("t", 4).alias("t"), F.round(p, 6).alias("p_value"))


def rank_pairs(points: DataFrame, order: str, value: str) -> DataFrame:
    """(series, s): over all pairs of a series' points in order, how many rise less how many fall; in n log n.

    With t the number of points before a point, two points differ in a highest bit of t. So for each bit, points that
    agree above it form a group, and each point with the bit is held against those without: as many as have smaller values
    less as many as have greater ones, which running counts over the group's values give. Points of equal order are no pair."""
    points = points.where(F.col(order).isNotNull() & F.col(value).isNotNull()).select("series", F.col(order).alias("o"), F.col(value).alias("v"), F.lit(1).cast("long").alias("one"))
    at = with_ties(points, ["series"], "o", {"upto": "one"})
    same = points.groupBy("series", "o").agg(F.count("*").alias("ties"))
    at = at.join(same, ["series", "o"]).select("series", "v", (F.col("upto") - F.col("ties")).alias("t"))
    bits = at.agg(F.max("t").alias("t")).withColumn("bits", F.length(F.bin("t")))
    each = at.crossJoin(F.broadcast(bits.select("bits"))).select("series", "v", "t", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    has = F.expr("shiftright(t, bit) & 1")
    sides = each.select("series", "bit", F.expr("shiftright(t, bit + 1)").alias("g"), "v", has.alias("late"), (1 - has).alias("early"))
    of_value = sides.groupBy("series", "bit", "g", "v").agg(F.sum("late").alias("late"), F.sum("early").alias("early"))
    upto = running_sums(of_value, ["series", "bit", "g"], ["v"], {"upto": "early"})
    groups = upto.groupBy("series", "bit", "g").agg(F.sum(F.col("late") * (2 * F.col("upto") - F.col("early"))).alias("a"), F.sum("late").alias("n_late"), F.sum("early").alias("n_early"))
    return groups.groupBy("series").agg(F.sum(F.col("a") - F.col("n_late") * F.col("n_early")).cast("double").alias("s"))


def mann_kendall(days: DataFrame, order: str, value: str) -> DataFrame:
    """S over all pairs of a series' days, its z, p-value and direction."""
    s = rank_pairs(days, order, value)
    n = days.groupBy("series").agg(F.count("*").alias("n"))
    rows = n.where("n > 1").join(s, "series", "left").fillna(0.0, ["s"]).withColumn("var", F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18)
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var")).otherwise(0.0)
    trend = F.when(F.abs("z") < 1.96, "no trend").when(F.col("z") > 0, "increasing").otherwise("decreasing")
    return rows.withColumn("p_value", F.round(2 * (1 - normal_cdf(F.abs(z))), 6)).withColumn("z", F.round(z, 4)).select("series", "n", "s", "z", "p_value", trend.alias("trend"))


def composite(df: DataFrame, group: str, metrics: list[str], base: str) -> DataFrame:
    """Variants by a composite, the mean of their metrics' means: the confidence in which it differs from the base (the gap as
    a share of the greater one, significant above 0.1), and the winner, which is the base unless another one is above it."""
    means = df.groupBy(F.col(group).alias("variant")).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"m{k}") for k, m in enumerate(metrics)])
    scored = means.withColumn("c", sum((F.col(f"m{k}") for k in range(len(metrics))), F.lit(0.0)) / len(metrics))
    first = F.struct(F.col("c"), F.when(F.col("variant") == base, 1).otherwise(0), F.col("variant"))
    ends = scored.agg(F.max(first).alias("top"), F.max(F.when(F.col("variant") == base, F.col("c"))).alias("of_base"))
    rows = scored.crossJoin(F.broadcast(ends)).withColumn("confidence", F.abs(F.col("c") - F.col("of_base")) / F.greatest("c", "of_base"))
    return rows.select("variant", "n", F.round("c", 6).alias("composite"), F.round("confidence", 6).alias("confidence"), (F.col("confidence") > 0.1).alias("significant"), (F.col("variant") == F.col("top.variant")).alias("winner"))


def control_chart(days: DataFrame, value: str, sigmas: float = 3.0) -> DataFrame:
    """Limits by series (mean +- sigmas sample deviations, the lower at least 0) and the days beyond them."""
    limits = days.groupBy("series").agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    low, high = F.greatest(F.col("mean") - sigmas * F.col("sd"), F.lit(0.0)), F.col("mean") + sigmas * F.col("sd")
    rows = days.join(limits, "series")
    return rows.groupBy("series").agg(F.round(F.first("mean"), 6).alias("mean"), F.round(F.first(low), 6).alias("lcl"), F.round(F.first(high), 6).alias("ucl"), F.count_if((F.col(value) < low) | (F.col(value) > high)).alias("out_of_control"), F.round(100 * F.avg(((F.col(value) >= low) & (F.col(value) <= high)).cast("double")), 4).alias("in_control_pct"))


def overall(days: DataFrame, hits: str, total: str) -> DataFrame:
    rate = F.col(hits) / F.col(total)
    return days.groupBy("series").agg(F.round(F.sum(hits) / F.sum(total), 6).alias("rate"), F.round(F.avg(rate), 6).alias("mean"), F.round(F.stddev_pop(rate), 6).alias("sd"), F.round(F.min(rate), 6).alias("low"), F.round(F.max(rate), 6).alias("high"))


def group_comparison(df: DataFrame, group: str, metric: str, base: str) -> DataFrame:
    """Means by variant and their relative change from the base; 'significant' is a gap above 10 %, as in the report."""
    means = df.groupBy(F.col(group).alias("variant")).agg(F.count("*").alias("n"), F.avg(metric).alias("m"))
    of_base = means.where(F.col("variant") == base).select(F.col("m").alias("b"))
    change = (F.col("m") - F.col("b")) / F.col("b")
    return means.crossJoin(F.broadcast(of_base)).select("variant", "n", F.round("m", 6).alias("mean"), F.round(100 * change, 4).alias("change_pct"), (F.abs(change) > 0.1).alias("significant"))


def month_matrix(df: DataFrame, day: str, column: str, values: list[str]) -> DataFrame:
    """Counts by month and value, zeros too."""
    return df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).pivot(column, values).count().fillna(0, values)


def word_counts(docs: DataFrame, text: str = "text", least: int = 4, top: int = 100) -> DataFrame:
    """The most frequent words without punctuation and digits, of at least `least` letters; a top-k report."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\s]", "")
    words = docs.select(F.explode(F.split(bare, r"\s+")).alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def series_of(lineitem: DataFrame) -> DataFrame:
    """Daily totals and returns of each ship mode of the data (line status): series, day, i, total, defects, rate."""
    days = lineitem.groupBy(F.col("l_linestatus").alias("series"), F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("defects"))
    return days.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("day"))).withColumn("rate", F.col("defects") / F.col("total"))
