"""Plant log operators: parsing lines, alerts by equipment, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line looks like, what words of a message mean its equipment's status, and what makes it an alert (fixed values).
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+([A-Z-0-9]+):\s+(.*)"
READINGS = ("temperature", "pressure", "speed")
STATUS = {"operational": "running|operational|normal", "down": "stopped|down|offline", "warning": "warning|caution"}
QUALITY = "defect|quality|tolerance|spec"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines `timestamp [LEVEL] EQUIPMENT: message` with the readings and the status that the message tells; other lines,
    and those whose time doesn't exist, drop."""
    part = lambda k: F.regexp_extract(F.trim("value"), LINE, k)
    ts = F.try_to_timestamp(F.nullif(part(1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = lines.select(ts.alias("ts"), part(2).alias("level"), part(3).alias("equipment"), part(4).alias("message")).where("ts is not null")
    number = lambda word: F.expr("try_cast(nullif(regexp_extract(lower(message), '" + word + r"[:\\s]+(\\d+\\.?\\d*)', 1), '') as double)")
    status = None
    for name, words in STATUS.items():  # the first that fits
        hit = F.lower("message").rlike(words)
        status = F.when(hit, name) if status is None else status.when(hit, name)
    return rows.select("*", *[number(w).alias(w) for w in READINGS], status.alias("status"))


def with_alert_kind(log: DataFrame) -> DataFrame:
    """A row for each kind of alert that a line is: error, maintenance or quality, or several of them."""
    low = F.lower("message")
    kinds = [F.when(F.col("level").isin("ERROR", "CRITICAL"), "error"), F.when(low.contains("maintenance"), "maintenance"), F.when(low.rlike(QUALITY), "quality")]
    return log.withColumn("alert_type", F.explode(F.array_compact(F.array(*kinds))))


def severity(critical: Column) -> Column:
    """Of an alert_type, given whether one of its lines is critical."""
    return F.when(F.col("alert_type") == "maintenance", "medium").when(F.col("alert_type") == "quality", "high").when(critical == 1, "critical").otherwise("high")


def alerts(log: DataFrame) -> DataFrame:
    """One row per equipment and kind of alert: errors (critical or high), maintenance (medium), quality (high)."""
    critical = F.max(F.when(F.col("level") == "CRITICAL", 1).otherwise(0))
    return with_alert_kind(log).groupBy("equipment", "alert_type").agg(F.count("*").alias("n"), severity(critical).alias("severity"), F.max_by("message", F.struct("ts", "message")).alias("last_message"))


def alert_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "alert_type").agg(F.count("*").alias("equipment"), F.sum("n").alias("messages"))
