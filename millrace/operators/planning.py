"""Inventory and material planning: stock status, available-to-promise, netting grid, demand and stock allocation.

The as-of date comes from the data (latest work-order close), never from the clock. All parts are planned in one plan;
what is broadcast is one row of dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.money import cents

from .running import running_sums, with_ties

FALLBACK_AS_OF = "2026-06-12"
OPEN_WORK = ["unreleased", "firmed", "released"]
OPEN_PURCHASE = ["Open", "Partial"]
PART = ["part_id", "part_description", "part_class", "unit_of_measure"]


def active(part: DataFrame) -> DataFrame:
    return part.where("active = 1")


def plan_start(work_order: DataFrame) -> DataFrame:
    """One row: the first day of the month of the latest close date, or of the fallback date."""
    return work_order.agg(F.trunc(F.coalesce(F.max("close_date"), F.lit(FALLBACK_AS_OF).cast("date")), "MM").alias("plan_start"))


def month_index(day: str | Column, start: str | Column) -> Column:
    """Whole months from the start's month to the day's."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (F.year(c(day)) - F.year(c(start))) * 12 + F.month(c(day)) - F.month(c(start))


def reorder_status(part: DataFrame) -> DataFrame:
    status = F.when(F.col("on_hand_qty") <= 0, "STOCKOUT").when(F.col("on_hand_qty") <= F.col("reorder_point"), "REORDER").otherwise("OK")
    return active(part).select(*PART, "on_hand_qty", "reorder_point", "lead_time_days", F.round(F.col("on_hand_qty") - F.col("reorder_point"), 2).alias("qty_vs_reorder"), status.alias("replenishment_status"))


def on_hand_value(part: DataFrame) -> DataFrame:
    q, r = F.col("on_hand_qty"), F.col("reorder_point")
    return active(part).groupBy("part_class").agg(
        F.count("*").alias("part_count"),
        F.round(F.sum(q), 2).alias("total_on_hand"),
        F.round(F.sum(q * F.col("unit_cost")), 2).alias("inventory_value"),
        F.count_if(q <= 0).alias("stockout_count"),
        F.count_if((q <= r) & (q > 0)).alias("at_reorder_count"),
        F.count_if(q > r).alias("adequate_count"),
    )


def lead_time_profile(part: DataFrame, long_days: int = 90) -> DataFrame:
    t = F.col("lead_time_days")
    return active(part).where(t > 0).groupBy("part_class").agg(F.count("*").alias("part_count"), F.round(F.avg(t), 1).alias("avg_lead_time_days"), F.min(t).alias("min_lead_time_days"), F.max(t).alias("max_lead_time_days"), F.count_if(t > long_days).alias("long_lead_count"))


def open_lines(customer_order: DataFrame, customer_order_line: DataFrame) -> DataFrame:
    return customer_order_line.join(customer_order.where("status = 'Open'").select("order_id", "order_date"), "order_id")


def scheduled_receipts(work_order: DataFrame, po_line: DataFrame, purchase_order: DataFrame) -> DataFrame:
    """part_id, day and quantity of open work orders and purchase lines."""
    made = work_order.where(F.col("status").isin(OPEN_WORK)).select("part_id", F.col("required_date").alias("day"), "quantity")
    bought = po_line.select("po_id", "part_id", "quantity").join(purchase_order.where(F.col("status").isin(OPEN_PURCHASE)).select("po_id", F.col("required_date").alias("day")), "po_id")
    return made.unionByName(bought.select("part_id", "day", "quantity")).where("day is not null")


def by_bucket(rows: DataFrame, day: str, qty: Column, start: DataFrame, months: int, out: str, past: int = -1) -> DataFrame:
    """Sums by part and month bucket: a day before the plan start is in bucket `past`; later ones than the horizon drop."""
    placed = rows.where(F.col(day).isNotNull()).crossJoin(F.broadcast(start))
    index = F.when(F.col(day) < F.col("plan_start"), past).otherwise(month_index(day, "plan_start") + past + 1).alias("bucket_index")
    return placed.select("part_id", index, qty.alias("q")).where(F.col("bucket_index") <= past + months).groupBy("part_id", "bucket_index").agg(F.sum("q").alias(out))


def time_phased_atp(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame, work_order: DataFrame, po_line: DataFrame, purchase_order: DataFrame, months: int = 6) -> DataFrame:
    """Every active part x (past due, M0..): requirements, receipts and the running balance, AVAILABLE or SHORT."""
    start = plan_start(work_order)
    demand = by_bucket(open_lines(customer_order, customer_order_line), "need_by_date", F.col("order_qty"), start, months, "gross_requirements")
    receipts = by_bucket(scheduled_receipts(work_order, po_line, purchase_order), "day", F.col("quantity"), start, months, "scheduled_receipts")
    grid = active(part).select(*PART, "on_hand_qty").withColumn("bucket_index", F.explode(F.sequence(F.lit(-1), F.lit(months - 1))))
    rows = grid.join(demand, ["part_id", "bucket_index"], "left").join(receipts, ["part_id", "bucket_index"], "left").fillna(0.0, ["gross_requirements", "scheduled_receipts"])
    running = F.sum(F.col("scheduled_receipts") - F.col("gross_requirements")).over(Window.partitionBy("part_id").orderBy("bucket_index").rowsBetween(Window.unboundedPreceding, 0))
    balance = F.col("on_hand_qty") + running
    label = F.when(F.col("bucket_index") < 0, "Past Due").otherwise(F.concat(F.lit("M"), F.col("bucket_index")))
    return rows.select(*PART, "bucket_index", label.alias("bucket"), "on_hand_qty", "gross_requirements", "scheduled_receipts", F.round(balance, 2).alias("atp_pab"), F.when(balance >= 0, "AVAILABLE").otherwise("SHORT").alias("atp_status"))


def allocated(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame) -> DataFrame:
    demand = open_lines(customer_order, customer_order_line).groupBy("part_id").agg(F.round(F.sum("order_qty"), 2).alias("allocated_qty"), F.countDistinct("order_id").alias("open_order_count"), F.min("need_by_date").cast("string").alias("earliest_need_by"))
    return active(part).select(*PART, "on_hand_qty").join(demand, "part_id")


def horizon_demand(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame, work_order: DataFrame, months: int = 6) -> DataFrame:
    """Active parts with open demand inside the horizon, its line count, the horizon's days and the daily average."""
    span = plan_start(work_order).withColumn("horizon_end", F.add_months("plan_start", months)).withColumn("horizon_days", F.datediff("horizon_end", "plan_start").cast("double"))
    demand = open_lines(customer_order, customer_order_line).crossJoin(F.broadcast(span)).where("need_by_date >= plan_start and need_by_date < horizon_end").groupBy("part_id").agg(F.sum("order_qty").alias("total_open_demand"), F.count("*").alias("open_line_count"))
    rows = active(part).join(demand, "part_id", "left").crossJoin(F.broadcast(span.select("horizon_days"))).fillna(0, ["total_open_demand", "open_line_count"])
    return rows.withColumn("daily", F.col("total_open_demand") / F.expr("nullif(horizon_days, 0)"))


def bad_lead() -> Column:
    return F.col("lead_time_days").isNull() | (F.col("lead_time_days") <= 0)


def safety_stock_proxy(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame, work_order: DataFrame) -> DataFrame:
    rows = horizon_demand(part, customer_order, customer_order_line, work_order).withColumn("lt", F.col("daily") * F.col("lead_time_days"))
    left = F.col("reorder_point") - F.col("lt")
    health = F.when(bad_lead(), "INVALID_LEAD_TIME").when(left < 0, "ROP_UNDERSTATED").when(left == 0, "ZERO_BUFFER").otherwise("ADEQUATE_BUFFER")
    return rows.select("part_id", "part_class", "reorder_point", "lead_time_days", "on_hand_qty", "total_open_demand", F.col("open_line_count").alias("open_order_count"), "horizon_days", F.round("daily", 4).alias("avg_daily_demand"), F.when(~bad_lead(), F.round("lt", 2)).alias("lt_demand_proxy"), F.when(~bad_lead(), F.round(left, 2)).alias("safety_stock_proxy"), health.alias("rop_health"))


def lead_time_demand(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame, work_order: DataFrame) -> DataFrame:
    rows = horizon_demand(part, customer_order, customer_order_line, work_order).withColumn("lt", F.round(F.col("daily") * F.col("lead_time_days"), 2))
    status = F.when(bad_lead(), "INVALID_LEAD_TIME").when(F.col("reorder_point") >= F.col("lt"), "ROP_COVERS_LT_DEMAND").otherwise("ROP_BELOW_LT_DEMAND")
    return rows.select("part_id", "part_class", "lead_time_days", "reorder_point", "total_open_demand", "open_line_count", "horizon_days", F.round("daily", 4).alias("avg_daily_demand"), F.when(~bad_lead(), F.col("lt")).alias("lead_time_demand"), status.alias("coverage_status"))


def minimum_stock(part: DataFrame) -> DataFrame:
    q, r = F.col("on_hand_qty"), F.col("reorder_point")
    status = F.when(q <= 0, "ZERO_STOCK").when(q < r, "BELOW_MINIMUM").when(q == r, "AT_MINIMUM").otherwise("ABOVE_MINIMUM")
    return active(part).select(*PART, r.alias("minimum_stock_qty"), q, "lead_time_days", F.round(q - r, 2).alias("buffer_above_min"), status.alias("min_stock_status"))


def purchase_history(po_line: DataFrame, purchase_order: DataFrame) -> DataFrame:
    """Average, total and count of the lines of purchase orders that weren't cancelled, by part."""
    real = purchase_order.where("status <> 'Cancelled'").select("po_id")
    return po_line.join(real, "po_id").groupBy("part_id").agg(F.round(F.avg("quantity"), 2).alias("avg_po_qty"), F.sum("quantity").alias("total_po_qty"), F.count("*").alias("po_line_count"))


def maximum_stock(part: DataFrame, po_line: DataFrame, purchase_order: DataFrame) -> DataFrame:
    rows = active(part).join(purchase_history(po_line, purchase_order), "part_id", "left").fillna(0, ["avg_po_qty", "po_line_count"])
    most = F.round(F.col("reorder_point") + F.col("avg_po_qty"), 2)
    status = F.when(F.col("on_hand_qty") > most, "OVERSTOCKED").when(F.col("on_hand_qty") < F.col("reorder_point"), "BELOW_MINIMUM").otherwise("IN_RANGE")
    return rows.select(*PART, F.col("reorder_point").alias("minimum_stock_qty"), F.col("avg_po_qty").alias("avg_replenishment_qty"), "po_line_count", most.alias("maximum_stock_qty"), "on_hand_qty", status.alias("minmax_status"))


def eoq_proxy(part: DataFrame, po_line: DataFrame, purchase_order: DataFrame) -> DataFrame:
    rows = active(part).join(purchase_history(po_line, purchase_order), "part_id", "left")
    lot = F.coalesce("avg_po_qty", "reorder_point")
    n = F.coalesce("po_line_count", F.lit(0))
    confidence = F.when(n == 0, "FALLBACK_TO_ROP").when(n == 1, "SINGLE_PO_OBSERVATION").otherwise("MULTI_PO_AVERAGE")
    return rows.select(*PART, "unit_cost", lot.alias("eoq_proxy"), F.coalesce("avg_po_qty", F.lit(0.0)).alias("avg_historical_po_qty"), F.coalesce("total_po_qty", F.lit(0.0)).alias("total_historical_po_qty"), n.alias("po_line_count"), cents(lot * F.col("unit_cost")).alias("eoq_order_value"), confidence.alias("eoq_confidence"))


def simple_atp(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame) -> DataFrame:
    wanted = open_lines(customer_order, customer_order_line).groupBy("part_id").agg(F.sum("order_qty").alias("open_demand_qty"))
    left = F.col("on_hand_qty") - F.col("open_demand_qty")
    return part.select("part_id", "part_description", "on_hand_qty").join(wanted, "part_id").select("*", F.round(left, 2).alias("available_to_promise"), F.when(left < 0, "SHORTAGE").otherwise("covered").alias("shortage_flag"))


def running_demand(customer_order: DataFrame, customer_order_line: DataFrame) -> DataFrame:
    lines = open_lines(customer_order, customer_order_line).select("part_id", "order_id", "line_no", "need_by_date", "order_qty")
    rows = running_sums(lines, ["part_id"], ["need_by_date", "order_id", "line_no"], {"running_demand": "order_qty"})
    return rows.withColumn("need_by_date", F.col("need_by_date").cast("string")).withColumn("running_demand", F.round("running_demand", 2))


def demand_register(customer_order: DataFrame, customer_order_line: DataFrame, part: DataFrame) -> DataFrame:
    lines = customer_order_line.join(customer_order.select("order_id", "customer_id", "status"), "order_id").join(part.select("part_id", "part_description"), "part_id")
    return lines.select("order_id", "line_no", "customer_id", "status", "part_id", "part_description", "order_qty", cents(F.col("unit_price"), 4).alias("unit_price"), cents(F.col("order_qty") * F.col("unit_price")).alias("line_value"))


def open_quantity(customer_order_line: DataFrame) -> DataFrame:
    return customer_order_line.select("order_line_id", "part_id", "order_qty", F.greatest(F.col("order_qty") - F.coalesce("shipped_qty", F.lit(0.0)), F.lit(0.0)).alias("open_qty"))


def forecast_of(customer_order_line: DataFrame) -> DataFrame:
    """A stand-in forecast for data without one: 1.1 times last year's need, a year later, by part and month."""
    return customer_order_line.where("need_by_date is not null").select("part_id", F.add_months(F.trunc("need_by_date", "MM"), 12).alias("forecast_date"), (F.col("order_qty") * 1.1).alias("forecast_qty"))


def netting_inputs(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame, forecast: DataFrame, work_order: DataFrame, po_line: DataFrame, purchase_order: DataFrame, months: int = 9) -> DataFrame:
    """part_id, bucket (0: past due), customer demand, forecast and receipts: every active part with a valid lead time."""
    start = plan_start(work_order)
    lines = open_lines(customer_order, customer_order_line)
    open_qty = F.greatest(F.col("order_qty") - F.coalesce("shipped_qty", F.lit(0.0)), F.lit(0.0))
    co = by_bucket(lines, "need_by_date", open_qty, start, months, "co", past=0)
    fc = by_bucket(forecast, "forecast_date", F.col("forecast_qty"), start, months, "fc", past=0)
    sched = by_bucket(scheduled_receipts(work_order, po_line, purchase_order), "day", F.col("quantity"), start, months, "sched", past=0)
    grid = active(part).where(~bad_lead()).select("part_id", "on_hand_qty", "safety_stock", "lead_time_days").withColumn("bucket_index", F.explode(F.sequence(F.lit(0), F.lit(months))))
    out = grid
    for x in (co, fc, sched):
        out = out.join(x, ["part_id", "bucket_index"], "left")
    return out.fillna(0.0, ["co", "fc", "sched"])


def netting_grid(inputs: DataFrame, start: DataFrame) -> DataFrame:
    """Lot-for-lot netting with safety stock, of all parts at once and without a loop.

    With d = receipts - gross and D its running sum, the balance is D + greatest(on hand, the largest of safety - D over
    the buckets so far that have gross demand); a planned receipt is the balance less what it would be without it. Its
    release is a lead time earlier, in the past-due bucket if that lies before the plan start.
    """
    so_far = Window.partitionBy("part_id").orderBy("bucket_index").rowsBetween(Window.unboundedPreceding, 0)
    by_part = Window.partitionBy("part_id").orderBy("bucket_index")
    x = inputs.withColumn("gross", F.greatest("co", "fc")).withColumn("d", F.col("sched") - F.col("gross"))
    x = x.withColumn("run", F.sum("d").over(so_far))
    lift = F.max(F.when(F.col("gross") > 0, F.col("safety_stock") - F.col("run"))).over(so_far)
    x = x.withColumn("pab", F.col("run") + F.greatest(F.col("on_hand_qty"), F.coalesce(lift, F.col("on_hand_qty"))))
    before = F.coalesce(F.lag("pab").over(by_part), F.col("on_hand_qty"))
    x = x.withColumn("net", F.round(F.col("pab") - (before + F.col("d")), 6)).crossJoin(F.broadcast(start))
    begins = F.when(F.col("bucket_index") == 0, F.col("plan_start")).otherwise(F.add_months("plan_start", F.col("bucket_index") - 1))
    day = F.date_sub(begins, F.col("lead_time_days").cast("int"))
    release_in = F.when((F.col("bucket_index") == 0) | (day < F.col("plan_start")), 0).otherwise(month_index(day, F.col("plan_start")) + 1)
    x = x.withColumn("release_in", release_in)
    releases = x.where("net > 0").groupBy("part_id", F.col("release_in").alias("bucket_index")).agg(F.sum("net").alias("planned_release"))
    rows = x.join(releases, ["part_id", "bucket_index"], "left")
    return rows.select("part_id", "bucket_index", F.round("gross", 4).alias("gross_requirements"), F.round("sched", 4).alias("scheduled_receipts"), F.round("pab", 4).alias("projected_balance"), (F.round("net", 4) + F.lit(0.0)).alias("net_requirement"), F.round(F.coalesce("planned_release", F.lit(0.0)), 4).alias("planned_release"))


def in_horizon(rows: DataFrame, day: str, work_order: DataFrame, months: int) -> DataFrame:
    """Rows whose day is in the months from the plan start on; past-due ones aren't."""
    span = plan_start(work_order).withColumn("horizon_end", F.add_months("plan_start", months))
    return rows.crossJoin(F.broadcast(span)).where(F.col(day).isNotNull() & (F.col(day) >= F.col("plan_start")) & (F.col(day) < F.col("horizon_end"))).drop("plan_start", "horizon_end")


def planning_parts(part: DataFrame, customer_order: DataFrame, customer_order_line: DataFrame, forecast: DataFrame, work_order: DataFrame, months: int = 9) -> DataFrame:
    """Parts with open order lines or forecasts in the horizon, active or not, and whatever their lead time: the lines, and
    what is open of them plus what is forecast. A forecast of a part that isn't there is left out."""
    lines = in_horizon(open_lines(customer_order, customer_order_line), "need_by_date", work_order, months)
    open_qty = F.greatest(F.col("order_qty") - F.coalesce("shipped_qty", F.lit(0.0)), F.lit(0.0))
    ordered = lines.groupBy("part_id").agg(F.count("*").alias("demand_lines"), F.sum(open_qty).alias("co"))
    expected = in_horizon(forecast.where("forecast_qty > 0"), "forecast_date", work_order, months).groupBy("part_id").agg(F.sum("forecast_qty").alias("fc"))
    rows = part.select("part_id", "part_class", "lead_time_days", "on_hand_qty").join(ordered.join(expected, "part_id", "full"), "part_id")
    return rows.select("part_id", "part_class", "lead_time_days", "on_hand_qty", F.coalesce("demand_lines", F.lit(0)).alias("demand_lines"), F.round(F.coalesce("co", F.lit(0.0)) + F.coalesce("fc", F.lit(0.0)), 4).alias("demand_qty"))


def planning_problems(parts: DataFrame, receipts: DataFrame, work_order: DataFrame, months: int = 9, strict: bool = False) -> DataFrame:
    """What keeps parts with demand (planning_parts) from being planned, a row a part: no usable lead time, else nothing on
    hand and no scheduled receipt in the horizon. strict: raises, with the first problems, if there are any."""
    coming = in_horizon(receipts, "day", work_order, months).select("part_id", F.lit(True).alias("coming")).distinct()
    bare = (F.coalesce("on_hand_qty", F.lit(0.0)) <= 0) & F.col("coming").isNull()
    problem = F.when(bad_lead(), "missing or non-positive lead_time_days").when(bare, "no on-hand inventory and no scheduled receipts in the horizon")
    out = parts.join(coming, "part_id", "left").select("part_id", problem.alias("problem")).where("problem is not null")
    if strict and (first := out.orderBy("part_id").limit(20).collect()):
        raise ValueError("planning inputs are incomplete: " + "; ".join(f"part {r.part_id}: {r.problem}" for r in first))
    return out


def forecast_consumption(inputs: DataFrame) -> DataFrame:
    return inputs.where("co > 0 or fc > 0").select("part_id", "bucket_index", F.round("co", 4).alias("customer_demand"), F.round("fc", 4).alias("forecast"), F.round(F.col("co") + F.greatest(F.col("fc") - F.col("co"), F.lit(0.0)), 4).alias("gross_requirements"))


def stock_allocation(part: DataFrame, requirement: DataFrame) -> DataFrame:
    """What is left on hand after each requirement, in order of the required date; equal dates share a balance."""
    rows = with_ties(requirement, ["part_id"], "required_date", {"taken": "open_qty"}).join(part.select("part_id", "on_hand_qty"), "part_id")
    return rows.select("requirement_id", "part_id", F.col("required_date").cast("string").alias("required_date"), "open_qty", F.round(F.col("on_hand_qty") - F.col("taken"), 2).alias("remaining"))


#: (class, type) of a transaction, what it is called and its sign: fixed values.
TRANSACTION_KINDS = [("R", "I", "Receive", 1), ("A", "O", "Adjust Out", -1), ("A", "I", "Adjust In", 1), ("I", "O", "Issue", -1), ("I", "I", "Issue Return", 1)]


def classify_transactions(transaction: DataFrame) -> DataFrame:
    kinds = transaction.sparkSession.createDataFrame(TRANSACTION_KINDS, "class string, type string, transaction_kind string, sign int")
    return transaction.join(F.broadcast(kinds), ["class", "type"], "left").groupBy("class", "type", "transaction_kind").agg(F.count("*").alias("transactions"), F.round(F.sum(F.col("quantity") * F.col("sign")), 2).alias("signed_qty"), F.min("trans_date").cast("string").alias("first_date"), F.max("trans_date").cast("string").alias("last_date"))


def reconcile_inventory(part: DataFrame, transaction: DataFrame) -> DataFrame:
    """Ledger net (type I in, else out) against the snapshot, by part, and by site the net and its last date."""
    net = transaction.groupBy("part_id").agg(F.sum(F.when(F.col("type") == "I", F.col("quantity")).otherwise(-F.col("quantity"))).alias("ledger_net"), F.count("*").alias("n_transactions"), F.max("trans_date").cast("string").alias("last_date"))
    return part.select("part_id", "on_hand_qty").join(net, "part_id").select("*", F.when(F.col("ledger_net") == F.col("on_hand_qty"), "Y").otherwise("N").alias("reconciled"), F.when(F.col("ledger_net") > 0, F.col("ledger_net")).otherwise(F.col("on_hand_qty")).alias("best_on_hand"))
