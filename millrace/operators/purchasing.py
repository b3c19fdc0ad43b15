"""Purchasing, payables and supplier operators. Child tables are aggregated before they join, so nothing fans out unless
the report's grain asks for it. Reports that depend on today take `as_of`; None means the latest date in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import cents


def latest(df: DataFrame, column: str, as_of: str | None) -> DataFrame:
    """One row: the as-of date, given or the latest in the data."""
    return df.agg(F.max(column).alias("as_of")) if as_of is None else df.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("as_of"))


def share(part: Column, whole: Column) -> Column:
    return part / F.when(whole != 0, whole)


def between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Null-guarded bounds: a bound that is None isn't a filter."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def supplier_master(suppliers: DataFrame) -> DataFrame:
    return suppliers.where("active = 1").select("supplier_id", "supplier_name", "category", "certification_level", "payment_terms", "lead_time_days", F.when(F.col("outside_service") == 1, "Yes").otherwise("No").alias("outside_service"))


def outside_service(suppliers: DataFrame) -> DataFrame:
    return suppliers.where("outside_service = 1 and active = 1").select("supplier_id", "supplier_name", "certification_level", "payment_terms", "lead_time_days")


def delivery_scorecard(suppliers: DataFrame, delivery: DataFrame) -> DataFrame:
    """All suppliers, silent ones too."""
    t = F.col("ontime_rate")
    seen = delivery.groupBy("supplier_id").agg(F.count("*").alias("deliveries"), F.round(F.avg(t) * 100, 4).alias("ontime_pct"), cents(F.avg("quality_score") * 100, 4).alias("quality_pct"), F.count_if(t >= 0.95).alias("excellent"), F.count_if(t < 0.80).alias("late"))
    rows = suppliers.select("supplier_id", "supplier_name").join(seen, "supplier_id", "left").fillna(0, ["deliveries", "excellent", "late"])
    return rows.withColumn("late_rate", F.round(share(F.col("late"), F.col("deliveries")), 4))


def late_penalties(delivery: DataFrame, rate: float = 0.02, worse_than: float = 0.80) -> DataFrame:
    """Late deliveries by supplier and actual quantity (the quantity is part of the grain, as in the report)."""
    late = delivery.where(F.col("ontime_rate") < worse_than).groupBy("supplier_id", "actual_quantity").agg(F.count("*").alias("late_deliveries"))
    return late.withColumn("penalty", F.round(F.col("late_deliveries") * F.col("actual_quantity") * rate, 4))


def exposure_estimate(suppliers: DataFrame, delivery: DataFrame, part: DataFrame) -> DataFrame:
    price = part.agg(F.round(F.avg("unit_cost"), 4).alias("avg_price"))
    units = delivery.groupBy("supplier_id").agg(F.sum("actual_quantity").alias("units"), F.round(F.avg("ontime_rate"), 4).alias("ontime"), F.round(F.avg("quality_score"), 4).alias("quality"))
    terms = F.when((F.col("ontime") >= 0.95) & (F.col("quality") >= 0.95), "Early-Pay Eligible").when((F.col("ontime") < 0.80) | (F.col("quality") < 0.85), "Hold — Review Required").otherwise("Standard Terms")
    return suppliers.select("supplier_id").join(units, "supplier_id").crossJoin(F.broadcast(price)).select("supplier_id", "units", F.round(F.col("units") * F.col("avg_price"), 2).alias("exposure"), terms.alias("payment_terms"))


def ap_total_due(payables: DataFrame, as_of: str | None = None) -> DataFrame:
    rows = payables.crossJoin(F.broadcast(latest(payables, "invoice_date", as_of)))
    due = F.col("status").isin("Open", "Disputed")
    total = lambda c, name: F.sum(F.when(c, F.col("amount_dollars")).otherwise(0.0).cast("decimal(18,2)")).cast("double").alias(name)
    return rows.groupBy("supplier_id").agg(total(due, "total_due"), total(F.col("status") == "Disputed", "disputed"), total(due & (F.col("due_date") < F.col("as_of")), "overdue"))


def ap_aging(payables: DataFrame, as_of: str | None = None) -> DataFrame:
    rows = payables.where("status in ('Open', 'Disputed')").crossJoin(F.broadcast(latest(payables, "invoice_date", as_of))).withColumn("days", F.datediff("as_of", "due_date"))
    total = lambda c, name: F.sum(F.when(c, F.col("amount_dollars")).otherwise(0.0).cast("decimal(18,2)")).cast("double").alias(name)
    d = F.col("days")
    return rows.groupBy("supplier_id").agg(total(d <= 0, "current"), total(d.between(1, 30), "days_1_30"), total(d.between(31, 60), "days_31_60"), total(d.between(61, 90), "days_61_90"), total(d > 90, "over_90"))


def open_orders_by_supplier(suppliers: DataFrame, purchase_order: DataFrame) -> DataFrame:
    return purchase_order.where("status in ('Open', 'Received')").join(suppliers.select("supplier_id", "supplier_name", "certification_level"), "supplier_id").groupBy("supplier_id", "supplier_name", "certification_level").agg(F.count("*").alias("open_po_count"), F.round(F.sum("total_cost"), 2).alias("total_open_value"))


def delivery_status(purchase_order: DataFrame, receiving_line: DataFrame, as_of: str | None = None) -> DataFrame:
    last = receiving_line.groupBy("po_id").agg(F.max("receipt_date").alias("last_receipt"))
    rows = purchase_order.join(last, "po_id", "left").crossJoin(F.broadcast(latest(receiving_line, "receipt_date", as_of)))
    waiting = ~F.col("status").isin("Cancelled", "Closed")
    status = (
        F.when(F.col("last_receipt") <= F.col("required_date"), "On Time")
        .when(F.col("last_receipt") > F.col("required_date"), "Late")
        .when(F.col("last_receipt").isNull() & waiting & (F.col("as_of") > F.col("required_date")), "Overdue — No Receipt")
        .when(F.col("last_receipt").isNull() & waiting, "Open — Pending")
        .otherwise("N/A")
    )
    return rows.select("po_id", "supplier_id", F.col("status").alias("po_status"), F.col("last_receipt").cast("string").alias("last_receipt_date"), status.alias("delivery_status"))


def received_by_line(receiving_line: DataFrame) -> DataFrame:
    return receiving_line.groupBy("po_line_id").agg(F.sum("quantity_received").alias("received"), F.max("receipt_date").alias("last_receipt")).withColumnRenamed("po_line_id", "line_id")


def _lines(purchase_order: DataFrame, po_line: DataFrame, receiving_line: DataFrame) -> DataFrame:
    real = purchase_order.where("status <> 'Cancelled'").select("po_id", "supplier_id", "status")
    return real.join(po_line.select("po_id", "line_id", "quantity"), "po_id").join(received_by_line(receiving_line), "line_id", "left").fillna(0.0, ["received"])


def fully_received(purchase_order: DataFrame, po_line: DataFrame, receiving_line: DataFrame) -> DataFrame:
    rows = _lines(purchase_order, po_line, receiving_line)
    return rows.groupBy("po_id", "supplier_id", "status").agg(F.count("*").alias("lines"), F.round(F.sum("quantity"), 1).alias("qty_ordered"), F.round(F.sum("received"), 1).alias("qty_received"), F.max("last_receipt").cast("string").alias("last_receipt_date"), F.bool_and(F.col("received") >= F.col("quantity")).alias("whole")).where("whole").drop("whole")


def short_orders(purchase_order: DataFrame, po_line: DataFrame, receiving_line: DataFrame) -> DataFrame:
    """Outstanding quantity is clipped at 0 line by line, so over-receipts never offset."""
    rows = _lines(purchase_order, po_line, receiving_line)
    r, q = F.col("received"), F.col("quantity")
    return rows.groupBy("po_id", "supplier_id", "status").agg(F.count("*").alias("lines"), F.count_if(r <= 0).alias("lines_unreceived"), F.count_if((r > 0) & (r < q)).alias("lines_short"), F.round(F.sum(F.greatest(q - r, F.lit(0.0))), 1).alias("qty_outstanding")).where("lines_unreceived + lines_short > 0")


def live_vouchers(payable_line: DataFrame, payables: DataFrame, end: str | None = None) -> DataFrame:
    """Voucher lines of invoices that are not cancelled, up to the end date."""
    return payable_line.join(between(payables.where("status <> 'Cancelled'"), "invoice_date", None, end).select("invoice_id"), "invoice_id")


def uninvoiced_receipts(receiving_line: DataFrame, payable_line: DataFrame, payables: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Receipts with a line that vouchers don't cover."""
    covered = live_vouchers(payable_line, payables, end).groupBy("receipt_line_id").agg(F.sum(F.abs("qty")).alias("invoiced"))
    rows = between(receiving_line, "receipt_date", start, end).join(covered, "receipt_line_id", "left")
    return rows.where("invoiced is null or quantity_received > invoiced").groupBy("receipt_id", "po_id", "supplier_id").agg(F.count("*").alias("open_lines"), F.max("receipt_date").cast("string").alias("received_date"))


def partial_receipt_accrual(purchase_order: DataFrame, po_line: DataFrame, receiving_line: DataFrame, payable_line: DataFrame, payables: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    got = received_by_line(between(receiving_line, "receipt_date", start, end))
    billed = live_vouchers(payable_line, payables, end).groupBy(F.col("po_line_id").alias("line_id")).agg(F.sum(F.abs("qty")).alias("invoiced"))
    rows = po_line.select("line_id", "po_id", "part_id", "quantity", "unit_cost").join(purchase_order.where("status <> 'Cancelled'").select("po_id", "supplier_id"), "po_id").join(got, "line_id").join(billed, "line_id", "left").fillna(0.0, ["invoiced"])
    rows = rows.where("received > 0 and received < quantity and invoiced < received")
    left = F.col("received") - F.col("invoiced")
    return rows.select("po_id", "line_id", "part_id", "supplier_id", F.round("quantity", 1).alias("qty_ordered"), F.round("received", 1).alias("qty_received"), F.round("invoiced", 1).alias("qty_invoiced"), F.round(left, 1).alias("qty_uninvoiced"), cents(left * F.col("unit_cost")).alias("accrued_value"), F.col("last_receipt").cast("string").alias("last_receipt_date"))


def three_way_match(purchase_order: DataFrame, po_line: DataFrame, suppliers: DataFrame, receiving_line: DataFrame, payable_line: DataFrame, payables: DataFrame, supplier: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Purchase line x receipt line x voucher line, with what exists of each and the match status. start and end bound the date
    of a receipt: a line that has receipts, but none in the window, has no row, and one without a receipt always has. A
    voucher after the end doesn't cover. None is no filter."""
    orders = purchase_order.where("status <> 'Cancelled'").select("po_id", "supplier_id", "site_id")
    orders = orders if supplier is None else orders.where(F.col("supplier_id") == supplier)
    lines = po_line.select("line_id", "po_id", "part_id", "quantity").join(orders, "po_id").join(suppliers.select("supplier_id", F.col("supplier_name").alias("vendor_name")), "supplier_id", "left")
    receipts = receiving_line.select(F.col("po_line_id").alias("line_id"), "receipt_line_id", "quantity_received", F.col("receipt_date").alias("received_date"))
    vouchers = payable_line.join(payables.select("invoice_id", F.lit(1).alias("document"), F.col("status").alias("voucher_status"), "invoice_date"), "invoice_id", "left")
    vouchers = vouchers.select("receipt_line_id", "payable_line_id", "qty", "invoice_id", "document", "voucher_status", "invoice_date")
    received = between(lines.join(receipts, "line_id", "left").where("receipt_line_id is not null"), "received_date", start, end)
    rows = received.unionByName(lines.join(receipts.select("line_id"), "line_id", "left_anti"), allowMissingColumns=True).join(vouchers, "receipt_line_id", "left")
    in_time = F.lit(True) if end is None else F.col("invoice_date") <= F.lit(end).cast("date")
    billed, exists = F.abs("qty"), lambda c: F.col(c).isNotNull().cast("int")
    status = (
        F.when(F.col("receipt_line_id").isNull(), "Not Received")
        .when(F.col("payable_line_id").isNull() | (F.col("voucher_status") == "Cancelled") | ~in_time, "Received-Uninvoiced")
        .when(billed < F.col("quantity_received"), "Partially Invoiced")
        .when(billed == F.col("quantity_received"), "Matched")
        .otherwise("Over-Invoiced")
    )
    day = lambda c: F.col(c).cast("string").alias(c)
    return rows.select(
        "po_id", "line_id", "part_id", "supplier_id", "vendor_name", "site_id", F.round("quantity", 1).alias("qty_ordered"), exists("receipt_line_id").alias("receipt_exists"), exists("payable_line_id").alias("voucher_exists"), exists("document").alias("invoice_document_exists"),
        "receipt_line_id", "payable_line_id", F.round(F.coalesce("quantity_received", F.lit(0.0)), 1).alias("qty_received"), day("received_date"), "invoice_id", day("invoice_date"), "voucher_status",
        F.round(F.when((F.col("voucher_status") != "Cancelled") & in_time, billed).otherwise(0.0), 1).alias("qty_invoiced"), status.alias("match_status"),
    )


def match_exceptions(match: DataFrame) -> DataFrame:
    return match.where("match_status in ('Partially Invoiced', 'Over-Invoiced')").groupBy("supplier_id", "match_status").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("qty_invoiced") - F.col("qty_received")), 2).alias("qty_gap"))


def supplier_exposure(delivery: DataFrame) -> DataFrame:
    """Parts a supplier delivers, as a share of all delivered parts."""
    pairs = delivery.select("supplier_id", "part_id").distinct()
    whole = delivery.select("part_id").distinct().agg(F.count("*").alias("n"))
    return pairs.groupBy("supplier_id").agg(F.count("*").alias("parts")).crossJoin(F.broadcast(whole)).select("supplier_id", "parts", F.round(100 * F.col("parts") / F.col("n"), 4).alias("pct_of_parts"))


def single_source_parts(delivery: DataFrame) -> DataFrame:
    return delivery.groupBy("part_id").agg(F.min("supplier_id").alias("supplier_id"), F.max("supplier_id").alias("other"), F.count("*").alias("deliveries")).where("supplier_id = other").drop("other")


def supplier_rating(suppliers: DataFrame, delivery: DataFrame) -> DataFrame:
    """5 * (0.55 on time + 0.45 quality), clamped to 1..5; 3.0 without history."""
    seen = delivery.groupBy("supplier_id").agg(F.avg("ontime_rate").alias("t"), F.avg("quality_score").alias("q"))
    rating = 5 * (0.55 * F.col("t") + 0.45 * F.coalesce("q", F.lit(0.75)))
    return suppliers.select("supplier_id").join(seen, "supplier_id", "left").select("supplier_id", F.round(F.when(F.col("t").isNull(), 3.0).otherwise(F.least(F.greatest(rating, F.lit(1.0)), F.lit(5.0))), 4).alias("rating"))


def daily_deliveries(delivery: DataFrame) -> DataFrame:
    on_time = F.col("ontime_rate") >= 1.0
    qty = F.col("actual_quantity")
    rows = delivery.groupBy(F.col("delivery_date").cast("string").alias("delivery_date")).agg(F.count("*").alias("deliveries"), F.sum(F.when(on_time, qty).otherwise(0.0)).alias("qty_on_time"), F.sum(F.when(on_time, 0.0).otherwise(qty)).alias("qty_late"))
    return rows.withColumn("on_time_pct", F.round(100 * F.col("qty_on_time") / (F.col("qty_on_time") + F.col("qty_late")), 4))


def windowed_scorecard(delivery: DataFrame, days: int, least: int, as_of: str | None = None) -> DataFrame:
    rows = delivery.crossJoin(F.broadcast(latest(delivery, "delivery_date", as_of))).where(F.col("delivery_date") >= F.date_sub("as_of", days))
    q = F.col("quality_score")
    return rows.groupBy("supplier_id").agg(F.count("*").alias("deliveries"), cents(F.avg("ontime_rate"), 4).alias("avg_ontime"), cents(F.avg(q), 4).alias("avg_quality"), F.count_if(q >= 0.95).alias("excellent"), F.count_if(q < 0.94).alias("poor")).where(F.col("deliveries") >= least)


def monthly_finance(delivery: DataFrame, per_unit: float = 15.0) -> DataFrame:
    late = F.col("ontime_rate") < 1.0
    return delivery.groupBy(F.date_format("delivery_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("deliveries"), F.round(100 * F.count_if(late) / F.count("*"), 4).alias("late_pct"), F.round(F.sum(F.when(late, F.col("actual_quantity") * per_unit).otherwise(0.0)), 2).alias("penalty"))


def unmatched_receivers(receiving_line: DataFrame, payable_line: DataFrame) -> DataFrame:
    return receiving_line.join(payable_line.select("receipt_line_id"), "receipt_line_id", "left_anti").select("receipt_line_id", "po_id", "supplier_id", F.round("quantity_received", 2).alias("quantity_received"))
