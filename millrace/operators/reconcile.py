"""Reconciliation: audits of documents against each other and of the ledger against its sources. An audit gives a row per
check with the number of its violations, or both sides of a sum; nothing is repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import COSTS, exact

#: Legal steps of a job's life (fixed values). Only completion closes a job, and only a released one.
STEPS = [("unreleased", "firmed"), ("unreleased", "released"), ("firmed", "released"), ("released", "closed")]
SHIFT_START_HOUR = 8


def violations(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def one_below_another(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def match_integrity(purchase_order: DataFrame, po_line: DataFrame, receiving: DataFrame, receiving_line: DataFrame, payables: DataFrame, payable_line: DataFrame) -> DataFrame:
    """Violations of the three-way match: closed orders fully received by one receipt a line; receipt headers agree with
    their lines and have some; invoices are the sums of their lines; matched lines are linked and covered; an exception
    has a short receipt; no link dangles. Child tables are summed before they join their headers."""
    received = receiving_line.groupBy(F.col("po_line_id").alias("line_id")).agg(F.max("quantity_received").alias("got"))
    closed = po_line.join(purchase_order.where("status = 'Closed'").select("po_id"), "po_id", "left_semi").join(received, "line_id", "left")
    of_receipt = receiving_line.groupBy("receipt_id").agg(F.sum(exact(F.col("quantity_received"))).alias("lines_qty"))
    headers = receiving.join(of_receipt, "receipt_id", "left")
    billed = payable_line.groupBy("invoice_id").agg(F.sum(exact(F.col("amount"))).alias("lines_amount"))
    invoices = payables.join(billed, "invoice_id", "left")
    covered = payable_line.join(receiving_line.select("receipt_line_id", "quantity_received"), "receipt_line_id", "left")
    short = covered.groupBy("invoice_id").agg(F.max((F.col("quantity_received") < F.col("qty")).cast("int")).alias("short"))
    states = payables.select("invoice_id", "match_status")
    dangling = lambda name, child, key, parent, parent_key: violations(f"dangling {name}", child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti"))
    return one_below_another(
        [
            violations("closed order not received", closed.where("got is null or got < quantity")),
            violations("receipt header differs", headers.where("lines_qty is not null and abs(quantity_received - cast(lines_qty as double)) > 0.005")),
            violations("receipt without lines", headers.where("lines_qty is null")),
            violations("invoice differs from its lines", invoices.where("abs(amount_dollars - coalesce(cast(lines_amount as double), 0)) > 0.01")),
            violations("matched line unlinked or short", covered.join(states.where("match_status = 'Matched'"), "invoice_id", "left_semi").where("receipt_line_id is null or quantity_received < qty")),
            violations("exception without mismatch", states.where("match_status = 'Exception'").join(short, "invoice_id").where("coalesce(short, 0) = 0")),
            violations("paid but pending", payables.where("status = 'Paid' and match_status = 'Pending'")),
            dangling("payable line", payable_line, "receipt_line_id", receiving_line, "receipt_line_id"),
            dangling("receiving line", receiving_line, "po_line_id", po_line, "line_id"),
            dangling("receipt", receiving, "po_id", purchase_order, "po_id"),
        ]
    )


def month_end(lines: DataFrame, material: DataFrame, labor: DataFrame, job: DataFrame, as_of: str | None = None) -> DataFrame:
    """Check rows (name, both sides, ok) of the ledger at a month's end against the documents it was posted from, and
    counts of jobs whose balance doesn't fit their state. Default as_of: the last whole month of the ledger's dates."""
    if as_of is None:
        end = lines.agg(F.last_day(F.add_months(F.max("event_date"), -1)).alias("as_of"))
    else:
        end = lines.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("as_of"))
    until = lambda df, date: df.crossJoin(F.broadcast(end)).where(F.col(date) <= F.col("as_of"))
    total = lambda df, c, name: df.agg(F.coalesce(F.sum(exact(c)), F.lit(0)).cast("decimal(38,2)").alias(name))
    posted = until(lines, "event_date")
    sums = posted.agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(exact(F.when(F.col("ledger") == x, F.col("amount")))), F.lit(0)).cast("decimal(38,2)").alias(x) for x in ("WIP", "FG")],
        F.coalesce(F.sum(exact(F.when((F.col("ledger") == "RM") & (F.col("amount") < 0), -F.col("amount")))), F.lit(0)).cast("decimal(38,2)").alias("RM"),
    )
    closed = until(job.where("status = 'closed'"), "close_date")
    for part in (total(until(material, "issue_date"), F.col("total_cost"), "issued"), total(until(labor, "clock_out"), F.col("labor_cost") + F.col("burden_cost"), "worked"), total(closed, F.col("act_cost"), "done")):
        sums = sums.crossJoin(part)
    of_job = posted.where("ledger = 'WIP'").groupBy("job_id").agg(F.sum(exact(F.col("amount"))).alias("balance"), F.sum(exact(F.greatest("amount", F.lit(0.0)))).alias("inflow"), F.count_if(F.col("amount") < 0).alias("outflows"))
    of_job = of_job.join(job.select("job_id"), "job_id", "left_semi").join(closed.select("job_id", F.lit(True).alias("is_closed")), "job_id", "left")
    states = of_job.agg(
        F.count_if(F.col("is_closed") & (F.abs("balance") > 0.005)).alias("closed_with_wip"),
        F.count_if(F.col("is_closed").isNull() & (F.abs(F.col("balance") - F.col("inflow")) > 0.005)).alias("open_off"),
        F.coalesce(F.sum(F.when(F.col("is_closed").isNull(), F.col("outflows"))), F.lit(0)).alias("early_out"),
    )
    one = sums.crossJoin(states)
    row = lambda name, lhs, rhs, ok: F.struct(F.lit(name).alias("check_name"), lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"), ok.alias("ok"))
    same = lambda name, lhs, rhs: row(name, lhs, rhs, F.abs(lhs - rhs) < 0.01)
    c, zero = F.col, F.lit(0)
    rows = F.array(
        row("window has events", c("n"), F.lit(1), c("n") > 0),
        same("WIP is inflows less completions", c("WIP"), c("issued") + c("worked") - c("done")),
        same("raw material outflow is issues", c("RM"), c("issued")),
        same("finished goods are closed jobs", c("FG"), c("done")),
        same("closed jobs without WIP", c("closed_with_wip"), zero),
        same("open jobs carry their inflows", c("open_off"), zero),
        same("no outflow before closing", c("early_out"), zero),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def lifecycle_violations(change: DataFrame, events: DataFrame) -> DataFrame:
    """Status changes (change_id, job_id, from_status, to_status) that break a rule: an illegal step, a planned order that
    is completed, a completion of a job without accumulated cost."""
    legal = reduce(lambda a, b: a | b, [(F.col("from_status") == x) & (F.col("to_status") == y) for x, y in STEPS])
    cost = events.where(F.col("event_type").isin(COSTS)).groupBy("job_id").agg(F.sum(exact(F.col("amount"))).alias("cost"))
    rows = change.where("from_status is not null and from_status <> to_status").join(cost, "job_id", "left")
    rules = F.array(
        F.when(~legal, F.lit("illegal step")), F.when(F.col("planned") & (F.col("to_status") == "closed"), F.lit("planned order completed")),
        F.when((F.col("to_status") == "closed") & (F.coalesce("cost", F.lit(0)) <= 0), F.lit("completed without cost")),
    )
    return rows.select("change_id", "job_id", "from_status", "to_status", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def labor_tickets(operation: DataFrame, resource: DataFrame, shift_start: int = SHIFT_START_HOUR) -> tuple[DataFrame, DataFrame]:
    """One ticket for each operation with labour cost: hours from the run rate, burden from the hours, clock-out behind
    the start of the shift. The second result has the operations that can't have one: no rate, or hours that round to 0."""
    rates = resource.select("resource_id", "run_cost_per_hr", "bur_per_hr_run")
    rows = operation.where("act_lab_cost > 0").join(rates, "resource_id", "left").withColumn("rate", F.coalesce("run_cost_per_hr", F.lit(0.0)))
    decimal = lambda c: F.round(c.cast("decimal(28,8)"), 2).cast("double")
    rows = rows.withColumn("hours", F.when(F.col("rate") > 0, decimal(F.col("act_lab_cost") / F.col("rate"))))
    good = rows.where("hours > 0")
    start = F.col("sched_start_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(shift_start))
    tickets = good.select(
        "wo_id", "sequence_no", "resource_id", "hours", decimal(F.col("act_lab_cost")).alias("labor_cost"), decimal(F.col("hours") * F.coalesce("bur_per_hr_run", F.lit(0.0))).alias("burden_cost"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("clock_in"), F.date_format(start + F.make_dt_interval(secs=F.round(F.col("hours") * 3600).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss").alias("clock_out"),
    )
    problems = rows.where("hours is null or hours <= 0").select("wo_id", "sequence_no", F.when(F.col("hours").isNull(), "no rate").otherwise("zero hours").alias("problem"))
    return tickets, problems


def shipment_relief(lines: DataFrame, ship_date: Column) -> DataFrame:
    """Shipment events that take each job's finished goods out in full; jobs without any have none."""
    inflow = lines.where("event_type = 'FG_COMPLETION' and ledger = 'FG'").groupBy("job_id").agg(F.sum(exact(F.col("amount"))).cast("double").alias("amount"))
    return inflow.where("amount > 0").select(F.col("job_id").alias("event_id"), "job_id", F.lit("CUSTOMER_SHIPMENT").alias("event_type"), "amount", ship_date.alias("event_date"), F.lit("customer_order_line").alias("source_table"), F.col("job_id").alias("source_id"))


def missing_related(df: DataFrame, key: list[str], has: str, lacks: str) -> DataFrame:
    """Rows that have the one text but lack the other (null or blank)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return df.where(~blank(has) & blank(lacks)).select(*key, has)


def remittance_classes(payment: DataFrame, invoice: DataFrame) -> DataFrame:
    """Payments (payment_id, reference, amount) matched with invoices (invoice_id, packlist_id, order_ref, amount) in
    tagged classes: 1 packlist and amount, 1B order and amount; for payments in neither, 2 packlist only, 3 and 4 the right
    and left part of a split reference, 5 no match, 6 no order. Classes may overlap, as a part can match too."""
    whole = payment.where("reference not like '%,%' and reference <> 'NO PO'")
    split = payment.where("reference like '%,%'").withColumns({"left_ref": F.trim(F.split("reference", ",")[0]), "right_ref": F.trim(F.element_at(F.split("reference", ","), -1))})
    packlist = invoice.select("invoice_id", F.col("packlist_id").alias("ref"), F.col("amount").alias("billed"))
    order = invoice.select("invoice_id", F.col("order_ref").alias("ref"), F.col("amount").alias("billed"))
    tagged = lambda rows, tag: rows.select("payment_id", "invoice_id", F.lit(tag).alias("match_class"))
    same = F.abs(F.col("amount") - F.col("billed")) < 0.005
    by = lambda rows, column, right: rows.withColumnRenamed(column, "ref").join(right, "ref")
    one, one_b = tagged(by(whole, "reference", packlist).where(same), "1"), tagged(by(whole, "reference", order).where(same), "1B")
    rest = whole.join(one.union(one_b).select("payment_id"), "payment_id", "left_anti")
    two = tagged(by(rest, "reference", packlist), "2")
    three, four = tagged(by(split, "right_ref", packlist), "3"), tagged(by(split, "left_ref", packlist), "4")
    matched = two.union(three).union(four).select("payment_id")
    none = lambda rows, tag: rows.select("payment_id", F.lit(None).cast("long").alias("invoice_id"), F.lit(tag).alias("match_class"))
    left = rest.select("payment_id").union(split.select("payment_id")).join(matched, "payment_id", "left_anti")
    return one_below_another([one, one_b, two, three, four, none(left, "5"), none(payment.where("reference = 'NO PO'"), "6")])


def procure_to_pay(po_line: DataFrame, receiving_line: DataFrame, payable_line: DataFrame, payables: DataFrame, suppliers: DataFrame, part: DataFrame) -> DataFrame:
    """Each purchase line with its receipts, vouchers and the voucher's status, and names of supplier and part."""
    received = receiving_line.select(F.col("po_line_id").alias("line_id"), "receipt_line_id", "quantity_received")
    billed = payable_line.select("receipt_line_id", "payable_line_id", "invoice_id", F.col("qty").alias("invoiced_qty"))
    rows = po_line.select("line_id", "po_id", "part_id", "supplier_id", "quantity").join(received, "line_id", "left").join(billed, "receipt_line_id", "left")
    rows = rows.join(payables.select("invoice_id", F.col("status").alias("payable_status")), "invoice_id", "left")
    rows = rows.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left").join(part.select("part_id", "part_description"), "part_id", "left")
    return rows.select("line_id", "po_id", "supplier_name", "part_description", "quantity", "receipt_line_id", "quantity_received", "payable_line_id", "invoiced_qty", "payable_status").distinct()
