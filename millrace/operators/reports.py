"""Smaller reports over purchasing, sales and the shop floor. Columns are named as users read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import cents

from .ledger import exact


def supplier_performance(suppliers: DataFrame, delivery: DataFrame, promised: str = "promised_date") -> DataFrame:
    """On-time share of all deliveries and mean days late of the late ones; suppliers without any are kept."""
    late = F.datediff("delivery_date", promised)
    rows = suppliers.select("supplier_id", "supplier_name").join(delivery.select("supplier_id", late.alias("late")), "supplier_id", "left")
    return rows.groupBy("supplier_id", "supplier_name").agg(F.count("late").alias("total_deliveries"), F.count_if(F.col("late") <= 0).alias("on_time_deliveries"), F.round(100 * F.count_if(F.col("late") <= 0) / F.nullif(F.count("late"), F.lit(0)), 2).alias("on_time_pct"), F.round(F.avg(F.when(F.col("late") > 0, F.col("late"))), 2).alias("avg_days_late"))


def product_quality(run: DataFrame, product: str = "part_id") -> DataFrame:
    """Defect rate of a product's runs, to 4 places."""
    return run.groupBy(product).agg(F.count("*").alias("runs"), F.sum("produced").alias("produced"), F.sum("defects").alias("defects")).withColumn("defect_rate", F.round(F.col("defects") / F.nullif(F.col("produced"), F.lit(0.0)), 4))


def order_status_list(purchase_order: DataFrame) -> DataFrame:
    return purchase_order.groupBy("status", "po_type").agg(F.count("*").alias("po_count"), F.sum(exact(F.col("total_cost"))).cast("double").alias("total_value"))


def high_risk_suppliers(delivery: DataFrame, products: int = 2, on_time: float = 80.0) -> DataFrame:
    """Suppliers of several products that are on time too seldom."""
    rows = delivery.groupBy("supplier_id").agg(F.countDistinct("part_id").alias("products"), F.round(100 * F.avg((F.col("ontime_rate") >= 1.0).cast("double")), 4).alias("on_time_pct"))
    return rows.where((F.col("products") >= products) & (F.col("on_time_pct") < on_time))


def supplier_averages(delivery: DataFrame) -> DataFrame:
    """The supplier's perspective on deliveries."""
    return delivery.groupBy("supplier_id").agg(F.count("*").alias("deliveries"), cents(100 * F.avg("ontime_rate"), 4).alias("avg_ontime_pct"), cents(100 * F.avg("quality_score"), 4).alias("avg_quality_pct"))


def delivery_totals(suppliers: DataFrame, delivery: DataFrame) -> DataFrame:
    """Per supplier, those without deliveries too: count, and means of the on-time rate and the quality."""
    seen = delivery.groupBy("supplier_id").agg(F.count("*").alias("n"), cents(F.avg("ontime_rate"), 6).alias("otd_avg"), cents(F.avg("quality_score"), 6).alias("quality_avg"))
    return suppliers.select("supplier_id").join(seen, "supplier_id", "left").select("supplier_id", F.coalesce("n", F.lit(0)).alias("delivery_count"), "otd_avg", "quality_avg")


def order_documents(po_line: DataFrame, document: DataFrame) -> DataFrame:
    """Lines with the documents of their part as one text, and what kind of part it is."""
    of_part = document.groupBy("part_id").agg(F.array_join(F.array_sort(F.collect_set("document_id")), ", ").alias("documents"), F.bool_or("stocked").alias("stocked"))
    label = F.when(F.col("stocked"), "Stocked").when(~F.col("stocked"), "Consumable").otherwise("Unknown")
    return po_line.select("line_id", "po_id", "part_id").join(of_part, "part_id", "left").select("line_id", "po_id", "part_id", F.coalesce("documents", F.lit("")).alias("documents"), label.alias("stock_label"))


def order_delivery(delivery: DataFrame, product_line: DataFrame, start: str | None = None) -> DataFrame:
    """Deliveries by day and product line, which a delivery has by its id modulo the greatest line id."""
    rows = delivery if start is None else delivery.where(F.col("delivery_date") >= F.lit(start).cast("date"))
    most = product_line.agg(F.max("product_line_id").alias("most"))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("product_line_id", F.col("delivery_id") % F.col("most") + 1).join(product_line, "product_line_id", "left")
    made, planned = F.sum("actual_quantity"), F.sum("planned_quantity")
    return rows.groupBy(F.col("delivery_date").cast("string").alias("delivery_date"), "product_line_name", "primary_market").agg(
        F.count("*").alias("total_deliveries"), cents(F.avg("ontime_rate") * 100, 1).alias("avg_ontime_pct"), cents(F.avg("quality_score") * 100, 1).alias("avg_quality_score"), made.alias("units_delivered"), planned.alias("units_planned"),
        F.round(made / F.nullif(planned, F.lit(0.0)) * 100, 1).alias("fill_rate_pct"), F.count_if(F.col("ontime_rate") >= 0.95).alias("on_time_count"), F.count_if(F.col("ontime_rate") < 0.80).alias("late_count"),
    )


def quality_exposure(defect: DataFrame, product_line: DataFrame, start: str | None = None, line: str | None = None) -> DataFrame:
    """Defects by product line with their rate, the critical and major ones, and 15 % of the unit price as rework cost."""
    rows = defect if start is None else defect.where(F.col("production_date") >= F.lit(start).cast("date"))
    rows = rows if line is None else rows.where(F.col("product_line") == line)
    rows = rows.join(product_line.withColumnRenamed("product_line_name", "product_line"), "product_line", "left")
    n = F.sum("defect_count")
    of = lambda severity, name: F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("defect_count"))), F.lit(0)).alias(name)
    return rows.groupBy("product_line", "primary_market", "unit_price").agg(
        F.count("*").alias("defect_events"), n.alias("total_defects"), F.sum("total_produced").alias("total_produced"), F.round(n / F.nullif(F.sum("total_produced"), F.lit(0)) * 100, 2).alias("overall_defect_rate_pct"),
        of("Critical", "critical_defects"), of("Major", "major_defects"), cents(n * F.col("unit_price") * 0.15).alias("estimated_rework_cost"),
    )


def packing_list(shipment: DataFrame, address: DataFrame, link: DataFrame, ship_from: str) -> DataFrame:
    """Shipped lines with the customer's first address, the linked work order and where they ship from."""
    first = address.groupBy("customer_id").agg(F.min_by("address", "address_no").alias("ship_to"))
    return shipment.join(first, "customer_id", "left").join(link.select("order_line_id", "wo_id"), "order_line_id", "left").select("order_line_id", "customer_id", "ship_to", "wo_id", "shipped_qty", F.lit(ship_from).alias("ship_from"))


def certification_compliance(resource: DataFrame, certification: DataFrame) -> DataFrame:
    """Certifications of active resources; a resource with several fans out, one without any is Missing."""
    held = certification.select("resource_id", "certification", "expires")
    rows = resource.where("active = 1").select("resource_id", "description").join(held, "resource_id", "left")
    return rows.select("resource_id", "description", "certification", F.col("expires").cast("string").alias("expires"), F.when(F.col("certification").isNull(), "Missing").otherwise("Held").alias("compliance"))


def active_operations(operation: DataFrame, resource: DataFrame) -> DataFrame:
    return operation.where("status in ('S', 'Q')").join(resource.where("active = 1").select("resource_id", "description"), "resource_id").select("wo_id", "sequence_no", "resource_id", "description", "status", (F.col("run_hrs") - F.col("act_run_hrs")).alias("hours_left"))


def cost_detail(work_order: DataFrame) -> DataFrame:
    """Actual cost of each work order by element and in sum."""
    parts = {k: exact(F.col(f"act_{k}_cost")) for k in ("lab", "bur", "ser", "mat")}
    return work_order.select("wo_id", "status", *[c.cast("double").alias(f"{k}_cost") for k, c in parts.items()], sum(parts.values(), F.lit(0)).cast("double").alias("total_cost"))


def shifts_required(weekly: DataFrame, shift_week: float = 40.0, current: int = 2) -> DataFrame:
    """Shifts that the peak week needs against the current ones."""
    rows = weekly.groupBy("resource_id").agg(F.max("load_hrs").alias("peak_load_hrs")).withColumn("shifts_required", F.ceil(F.col("peak_load_hrs") / shift_week))
    advice = F.when(F.col("shifts_required") > current, "Add shifts").when(F.col("shifts_required") < current, "Reduce shifts").otherwise("Keep")
    return rows.withColumn("recommendation", advice)


def capacity_totals(operation: DataFrame, transaction: DataFrame) -> DataFrame:
    """Totals as (measure, key, value): load in all and by work center, run hours and steps, quantities in and out."""
    load = F.col("setup_hrs") + F.col("run_hrs")
    total = lambda df, measure, value: df.agg(value.cast("double").alias("value")).select(F.lit(measure).alias("measure"), F.lit("all").alias("key"), F.round("value", 2).alias("value"))
    by = lambda df, measure, key, value: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.round(value.cast("double"), 2).alias("value")).select(F.lit(measure).alias("measure"), "key", "value")
    into, out = transaction.where("type = 'I'"), transaction.where("type = 'O'")
    parts = [
        total(operation, "capacity_total_load", F.sum(load)), by(operation, "work_center_load", "resource_id", F.sum(load)), total(operation, "routing_total_run_hours", F.sum("run_hrs")), by(operation, "work_order_step_count", "wo_id", F.count("*")),
        total(into, "total_in_qty", F.sum("quantity")), total(out, "total_out_qty", F.sum("quantity")), by(into, "part_in_qty", "part_id", F.sum("quantity")), by(out, "part_out_qty", "part_id", F.sum("quantity")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows


def tie_out_actuals(lines: DataFrame, job: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Jobs whose finished goods in the ledger differ from the cost that their job record has."""
    posted = lines.where("ledger = 'FG'").groupBy("job_id").agg(F.sum(exact(F.col("amount"))).alias("posted"))
    gap = exact(F.col("act_cost")) - F.coalesce("posted", F.lit(0))
    return job.join(posted, "job_id", "left").withColumn("gap", gap.cast("double")).where(F.abs("gap") >= tolerance).select("job_id", "act_cost", F.coalesce(F.col("posted").cast("double"), F.lit(0.0)).alias("posted"), "gap")
