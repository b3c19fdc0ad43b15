"""Job-cost ledger: posting of events to signed ledgers, and the reports and checks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .purchasing import between

#: What an event posts: (event, ledger, sign). Fixed values.
POSTINGS = [
    ("RM_ISSUE", "RM", -1),
    ("RM_ISSUE", "WIP", 1),
    ("LABOR", "WIP", 1),
    ("BURDEN", "WIP", 1),
    ("FG_COMPLETION", "WIP", -1),
    ("FG_COMPLETION", "FG", 1),
    ("CUSTOMER_SHIPMENT", "FG", -1),
]
#: Cost elements that a job collects.
COSTS = ["RM_ISSUE", "LABOR", "BURDEN"]
BUCKETS = [(1, "RM", "Raw Materials"), (2, "WIP", "Work in Process"), (3, "FG", "Finished Goods")]


def exact(c):
    return c.cast("decimal(18,2)")


def post(events: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Signed ledger lines of events with an amount above 0 and a date. An event's key is (source table, source id,
    event type): repeated keys post once, and keys in `posted` not again."""
    key = ["source_table", "source_id", "event_type"]
    good = events.where("amount > 0 and event_date is not null").dropDuplicates(key)
    if posted is not None:
        good = good.join(posted.select(*key).distinct(), key, "left_anti")
    return post_lines(good)


def post_lines(good: DataFrame) -> DataFrame:
    """The signed ledger lines of valid events, batch or stream."""
    lines = F.when(F.lit(False), F.array().cast("array<struct<ledger:string,sign:int>>"))
    for kind in sorted({p[0] for p in POSTINGS}):
        lines = lines.when(F.col("event_type") == kind, F.array(*[F.struct(F.lit(ledger).alias("ledger"), F.lit(sign).alias("sign")) for k, ledger, sign in POSTINGS if k == kind]))
    out = good.withColumn("line", F.explode(lines))
    return out.select("event_id", "job_id", "event_type", "event_date", "source_table", "source_id", F.col("line.ledger").alias("ledger"), F.round(F.col("amount") * F.col("line.sign"), 2).alias("amount"))


def bucket_balances(lines: DataFrame, as_of: str | None = None) -> DataFrame:
    names = lines.sparkSession.createDataFrame(BUCKETS, "bucket_order int, ledger string, inventory_bucket string")
    sums = between(lines, "event_date", None, as_of).groupBy("ledger").agg(F.count("*").alias("posting_count"), F.sum(exact(F.col("amount"))).cast("double").alias("balance"))
    return F.broadcast(names).join(sums, "ledger", "left").fillna(0, ["posting_count"]).drop("ledger")


def job_cost_summary(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return between(events.where(F.col("event_type").isin(COSTS)), "event_date", start, end).groupBy("job_id", F.col("event_type").alias("cost_element")).agg(F.count("*").alias("posting_count"), F.sum(exact(F.col("amount"))).cast("double").alias("total_cost"))


def event_trace(events: DataFrame, job_id: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = between(events if job_id is None else events.where(F.col("job_id") == job_id), "event_date", start, end)
    return rows.select("event_id", "job_id", "event_type", "amount", F.col("event_date").cast("string").alias("event_date"), "source_table", "source_id")


def issued_or_produced(lines: DataFrame, event_type: str, ledger: str) -> DataFrame:
    """Material issued (from raw materials) or goods produced (into finished goods), by job."""
    sign = -1 if ledger == "RM" else 1
    rows = lines.where((F.col("event_type") == event_type) & (F.col("ledger") == ledger))
    return rows.groupBy("job_id").agg(F.count("*").alias("postings"), F.sum(exact(F.col("amount") * sign)).cast("double").alias("value"), F.min("event_date").cast("string").alias("first_date"), F.max("event_date").cast("string").alias("last_date"))


def tie_out(events: DataFrame, lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Jobs whose cost events and work-in-process inflow differ."""
    cost = events.where(F.col("event_type").isin(COSTS)).groupBy("job_id").agg(F.sum(exact(F.col("amount"))).alias("cost"))
    inflow = lines.where("ledger = 'WIP' and amount > 0").groupBy("job_id").agg(F.sum(exact(F.col("amount"))).alias("inflow"))
    gap = F.coalesce("cost", F.lit(0)) - F.coalesce("inflow", F.lit(0))
    return cost.join(inflow, "job_id", "full").withColumn("gap", gap.cast("double")).where(F.abs("gap") >= tolerance).select("job_id", F.col("cost").cast("double").alias("cost"), F.col("inflow").cast("double").alias("inflow"), "gap")


def month_end(lines: DataFrame) -> DataFrame:
    """Check rows by month: what left work in process equals what came into finished goods."""
    of = lambda ledger, event: F.sum(exact(F.when((F.col("ledger") == ledger) & (F.col("event_type") == event), F.col("amount")).otherwise(0.0))).cast("double")
    rows = lines.groupBy(F.date_format("event_date", "yyyy-MM").alias("month")).agg((-of("WIP", "FG_COMPLETION")).alias("lhs"), of("FG", "FG_COMPLETION").alias("rhs"))
    return rows.select("month", F.lit("completion").alias("check_name"), (F.col("lhs") + 0.0).alias("lhs"), "rhs", (F.abs(F.col("lhs") - F.col("rhs")) < 0.005).alias("ok"))


def lifecycle_trace(events: DataFrame) -> DataFrame:
    """Stages of each job: created, cost events, completed, with their order."""
    created = events.groupBy("job_id").agg(F.min("event_date").alias("d")).select("job_id", F.lit(1).alias("stage_order"), F.lit("created").alias("stage"), "d", F.lit(None).cast("long").alias("event_id"))
    cost = events.where(F.col("event_type").isin(COSTS)).select("job_id", F.lit(2), F.lit("cost_event"), "event_date", "event_id")
    done = events.where("event_type = 'FG_COMPLETION'").select("job_id", F.lit(3), F.lit("completed"), "event_date", "event_id")
    return created.union(cost).union(done).select("job_id", "stage_order", "stage", F.col("d").cast("string").alias("stage_date"), "event_id")


def ledger_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("ledger", "event_type").agg(F.count("*").alias("lines"), F.sum(exact(F.col("amount"))).cast("double").alias("total"))


def resolve_job(references: DataFrame, work_order: DataFrame) -> DataFrame:
    """'job 42', '42', 'WO-00042' to a work order: its id, and found, none or ambiguous."""
    wanted = references.withColumn("wo_id", F.expr(r"try_cast(nullif(regexp_extract(reference, '(\\d+)\\s*$', 1), '') as bigint)"))
    counts = work_order.groupBy("wo_id").agg(F.count("*").alias("n"))
    return wanted.join(counts, "wo_id", "left").select("reference", F.when(F.col("n") == 1, F.col("wo_id")).alias("wo_id"), F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("result"))
