"""Customer order, revenue and receivable operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .purchasing import latest
from .running import with_ties


def money(c, name: str):
    """Cent-exact sum as a double."""
    return F.sum(c.cast("decimal(18,2)")).cast("double").alias(name)


def order_lifecycle(customer_order: DataFrame, customer_order_line: DataFrame, as_of: str | None = None) -> DataFrame:
    lines = customer_order_line.groupBy("order_id").agg(F.sum("order_qty").alias("ordered"), F.sum(F.coalesce("shipped_qty", F.lit(0.0))).alias("shipped"), F.max("need_by_date").alias("due"))
    rows = customer_order.join(lines, "order_id").crossJoin(F.broadcast(latest(customer_order, "order_date", as_of)))
    done = F.col("status") == "Closed"
    state = F.when(done & (F.col("due") <= F.date_add("order_date", 400)), "On Time").when(done, "Late").when(F.col("due") < F.col("as_of"), "Overdue").otherwise("In Progress")
    return rows.select("order_id", "status", F.round(100 * F.col("shipped") / F.col("ordered"), 4).alias("completion_pct"), state.alias("lifecycle"))


def customer_profile(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The address string is null if a part of it is."""
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("c_custkey").alias("customer_id"), F.concat_ws(" ", F.col("c_mktsegment"), F.col("c_name")).alias("full_name"), F.concat(F.col("n_name"), F.lit(", "), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))).alias("address"))


def customers_by_region(customer: DataFrame, nation: DataFrame) -> DataFrame:
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("segments"))


def customer_revenue(customer_order: DataFrame, customer_order_line: DataFrame) -> DataFrame:
    rows = customer_order.join(customer_order_line, "order_id")
    return rows.groupBy("customer_id").agg(F.countDistinct("order_id").alias("orders"), F.countDistinct("part_id").alias("products"), F.round(F.sum("order_qty"), 2).alias("units"))


def revenue_recognition(customer_order: DataFrame) -> DataFrame:
    stage = F.when(F.col("status") == "Closed", "Recognized").when(F.col("status") == "Shipped", "Billable — shipped, not closed").otherwise("Backlog — booked, not recognizable")
    return customer_order.groupBy(stage.alias("revenue_stage")).agg(F.count("*").alias("orders"), money(F.col("total_price"), "amount"))


def customer_exposure(customer_order: DataFrame) -> DataFrame:
    of = lambda status, name: money(F.when(F.col("status") == status, F.col("total_price")).otherwise(0.0), name)
    return customer_order.groupBy("customer_id").agg(of("Shipped", "billable"), of("Open", "backlog"), of("Closed", "recognized"))


def backlog_aging(customer_order: DataFrame, as_of: str | None = None) -> DataFrame:
    rows = customer_order.where("status = 'Open'").crossJoin(F.broadcast(latest(customer_order, "order_date", as_of)))
    days = F.datediff("as_of", "order_date")
    bucket = F.when(days <= 30, "0-30").when(days <= 90, "31-90").when(days <= 180, "91-180").otherwise("Over 180 days")
    return rows.groupBy(bucket.alias("age_bucket")).agg(F.count("*").alias("orders"), money(F.col("total_price"), "amount"))


def ar_aging(receivable: DataFrame) -> DataFrame:
    """As of the latest payment of a paid invoice; a null due date falls to the oldest bucket, as in the report."""
    as_of = receivable.where("status = 'Paid'").agg(F.max("payment_date").alias("as_of"))
    days = F.datediff("as_of", "due_date")
    bucket = F.when(days <= 0, "Current").when(days <= 30, "1-30").when(days <= 60, "31-60").otherwise(">60")
    return receivable.where("status <> 'Paid'").crossJoin(F.broadcast(as_of)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("invoices"), money(F.col("amount_dollars"), "amount"))


def cash_receipts(receivable: DataFrame, receivable_payment: DataFrame) -> DataFrame:
    """Cumulative by invoice; installments of one date share their total (the default frame)."""
    exact = receivable_payment.withColumn("_exact", F.col("amount").cast("decimal(18,2)"))
    rows = with_ties(exact, ["invoice_id"], "payment_date", {"_paid": "_exact"}).join(receivable.select("invoice_id", "amount_dollars"), "invoice_id")
    paid = F.col("_paid").cast("double")
    return rows.select("invoice_id", "installment_no", F.col("payment_date").cast("string").alias("payment_date"), "amount", paid.alias("cumulative_paid"), F.round(F.col("amount_dollars") - paid, 2).alias("remaining"))


def monthly_orders(customer_order: DataFrame, months: int = 12) -> DataFrame:
    """Orders placed and completed in each of the last months, zeros too: a dense calendar."""
    last = customer_order.agg(F.trunc(F.max("order_date"), "MM").alias("m"))
    calendar = last.select(F.explode(F.sequence(F.add_months("m", 1 - months), F.col("m"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    counts = customer_order.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("placed"), F.count_if(F.col("status") == "Closed").alias("completed"))
    return F.broadcast(calendar).join(counts, "month", "left").fillna(0)


def installments(receivable: DataFrame, parts: int = 3) -> DataFrame:
    """Equal cents; the last installment takes the remainder."""
    total = F.round(F.col("amount_dollars") * 100).cast("long")
    rows = receivable.select("invoice_id", total.alias("total")).withColumn("installment_no", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    each = F.expr(f"total div {parts}")
    return rows.select("invoice_id", "installment_no", F.when(F.col("installment_no") < parts, each).otherwise(F.col("total") - (parts - 1) * each).alias("cents"))


def open_demand(customer_order: DataFrame, customer_order_line: DataFrame) -> DataFrame:
    rows = customer_order_line.join(customer_order.where("status = 'Open'").select("order_id"), "order_id")
    return rows.groupBy("part_id").agg(F.round(F.sum("order_qty"), 2).alias("open_qty"), F.round(F.sum(F.col("order_qty") * F.col("unit_price")), 2).alias("open_value"))


def routing_pivot(order_line: DataFrame) -> DataFrame:
    """Lines per order by return flag, as columns; a flag an order doesn't have counts 0."""
    flags = ["A", "N", "R"]
    return order_line.groupBy("order_id").pivot("return_flag", flags).count().fillna(0, flags)


def date_history(customer_order_line: DataFrame) -> DataFrame:
    """The dates an order's lines were due, in order, and the latest."""
    rows = customer_order_line.groupBy("order_id").agg(F.array_sort(F.collect_set(F.col("need_by_date").cast("string"))).alias("dates"))
    return rows.select("order_id", F.array_join("dates", "; ").alias("date_history"), F.array_max("dates").alias("latest_date"))
