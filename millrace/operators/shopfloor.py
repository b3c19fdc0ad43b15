"""Shop-floor operators: resources, operations, capacity and work orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import cents

from .purchasing import latest

RESOURCE = ["resource_id", "description", "resource_type"]


def ratio(a: str, b: str, places: int = 4):
    return F.when(F.sum(b) > 0, cents(F.sum(a) / F.sum(b), places))


def oee_operational(shop_resource: DataFrame, operation: DataFrame) -> DataFrame:
    rows = shop_resource.where("active = 1").select(*RESOURCE).join(operation.drop("close_date"), "resource_id", "left")
    return rows.groupBy(*RESOURCE).agg(F.count("wo_id").alias("operation_count"), cents(F.sum("run_hrs")).alias("scheduled_run_hrs"), cents(F.sum("act_run_hrs")).alias("actual_run_hrs"), ratio("act_run_hrs", "run_hrs").alias("performance_ratio"))


def oee_strategic(shop_resource: DataFrame, operation: DataFrame) -> DataFrame:
    rows = shop_resource.where("active = 1").select(*RESOURCE).join(operation, "resource_id", "left").withColumn("cost", F.col("act_lab_cost") + F.col("act_bur_cost"))
    return rows.groupBy("resource_type").agg(F.countDistinct("resource_id").alias("resource_count"), cents(F.sum("run_hrs")).alias("total_scheduled_hrs"), cents(F.sum("cost")).alias("total_actual_cost"), ratio("cost", "act_run_hrs", 2).alias("cost_per_actual_hr"), ratio("act_run_hrs", "run_hrs").alias("utilization_ratio"))


def open_operations(shop_resource: DataFrame, operation: DataFrame) -> DataFrame:
    rows = shop_resource.where("active = 1").select(*RESOURCE).join(operation, "resource_id", "left")
    is_open = F.col("status") != "C"
    return rows.groupBy(*RESOURCE).agg(F.count_if(is_open).alias("open_operations"), cents(F.sum(F.when(is_open, F.col("run_hrs") - F.col("act_run_hrs")).otherwise(0.0))).alias("remaining_run_hrs"), F.max("close_date").cast("string").alias("last_close_date"))


def delivery_state(work_order: DataFrame, as_of: str | None = None, risk_days: int = 7) -> DataFrame:
    rows = work_order.crossJoin(F.broadcast(latest(work_order, "open_date", as_of)))
    c, r, a = F.col("close_date"), F.col("required_date"), F.col("as_of")
    state = F.when(c <= r, "On Time").when(c > r, "Late").when(a > r, "Overdue").when(a > F.date_sub(r, risk_days), "At Risk").otherwise("On Schedule")
    return rows.select("wo_id", "part_id", "status", state.alias("customer_delivery_status"))


def status_rollup(work_order: DataFrame) -> DataFrame:
    cost = sum((F.col(f"act_{k}_cost").cast("decimal(18,2)") for k in ("lab", "bur", "ser", "mat")), F.lit(0))
    return work_order.groupBy("status").agg(F.count("*").alias("order_count"), F.sum("quantity").alias("total_qty"), F.sum(cost).cast("double").alias("total_actual_cost"), F.sum("outside_service").alias("orders_with_outside_service"))


def load_register(operation: DataFrame) -> DataFrame:
    """Operations by Monday week; load is setup plus run."""
    return operation.where("sched_start_date is not null").select("wo_id", "resource_id", F.date_trunc("week", "sched_start_date").cast("date").cast("string").alias("week_start"), (F.col("setup_hrs") + F.col("run_hrs")).alias("load_hrs"))


def weekly_load(operation: DataFrame, shifts: int = 2, hours: float = 8.0, days: int = 5) -> DataFrame:
    capacity = shifts * hours * days
    load = F.round(F.sum("load_hrs"), 4)
    return load_register(operation).groupBy("resource_id", "week_start").agg(F.count("*").alias("operations"), load.alias("load_hrs")).select("*", F.lit(capacity).alias("capacity_hrs"), F.round(100 * F.col("load_hrs") / capacity, 4).alias("util_pct"), F.when(F.col("load_hrs") > capacity, "OVER").otherwise("ok").alias("verdict"))


def bottlenecks(weekly: DataFrame, shift_week: float = 40.0) -> DataFrame:
    """Peak and overloaded weeks by resource, and the shifts the peak needs."""
    rows = weekly.groupBy("resource_id").agg(F.max("load_hrs").alias("peak_load_hrs"), F.count_if(F.col("verdict") == "OVER").alias("weeks_over"), F.count("*").alias("weeks"))
    verdict = F.when(F.col("weeks_over") == 0, "ok").when(2 * F.col("weeks_over") >= F.col("weeks"), "BOTTLENECK").otherwise("watch")
    return rows.select("*", verdict.alias("verdict"), F.ceil(F.col("peak_load_hrs") / shift_week).alias("shifts_required"))


def routing_traveler(operation: DataFrame, shop_resource: DataFrame) -> DataFrame:
    rows = operation.join(shop_resource.select("resource_id", "description", "run_cost_per_hr"), "resource_id")
    return rows.select("wo_id", "sequence_no", "resource_id", "description", "status", cents(F.col("run_hrs"), 4).alias("sched_hrs"), cents(F.col("act_run_hrs"), 4).alias("actual_hrs"), cents(F.col("run_hrs") * F.col("run_cost_per_hr")).alias("sched_cost"))


def station_load(operation: DataFrame) -> DataFrame:
    return operation.groupBy("resource_id", "status").agg(F.count("*").alias("operations"), cents(F.sum(F.col("setup_hrs") + F.col("run_hrs"))).alias("hours"))


def actual_cost_rollup(operation: DataFrame, shop_resource: DataFrame) -> DataFrame:
    """Labor and burden of work orders from their operations: closed ones count whole, started ones half."""
    weight = F.when(F.col("status") == "C", 1.0).when(F.col("status") == "S", 0.5).otherwise(0.0)
    rows = operation.join(shop_resource.select("resource_id", "run_cost_per_hr", "bur_per_hr_run"), "resource_id").withColumn("hours", F.col("run_hrs") * weight)
    return rows.groupBy("wo_id").agg(cents(F.sum(F.col("hours") * F.col("run_cost_per_hr"))).alias("labor"), cents(F.sum(F.col("hours") * F.col("bur_per_hr_run"))).alias("burden"))
