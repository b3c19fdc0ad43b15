"""Edges that the shared tables don't hold, with answers worked out by hand or by a plain loop."""

import datetime as dt
import random

import pytest

from millrace.operators import cleansing, graph, ledger, planning, purchasing

DAY = dt.date


def part(spark, rows):
    return spark.createDataFrame(rows, "part_id long, part_description string, part_class string, unit_of_measure string, unit_cost double, lead_time_days long, reorder_point double, on_hand_qty double, safety_stock double, active int")


def test_atp_buckets_at_their_edges(spark):
    parts = part(spark, [(1, "a", "RAW", "EA", 1.0, 5, 0.0, 10.0, 0.0, 1), (2, "b", "RAW", "EA", 1.0, 5, 0.0, 1.0, 0.0, 0)])
    orders = spark.createDataFrame([(1, DAY(2026, 1, 1), "Open"), (2, DAY(2026, 1, 1), "Closed")], "order_id long, order_date date, status string")
    lines = spark.createDataFrame(
        [(1, 1, DAY(2026, 5, 31), 3.0), (1, 1, DAY(2026, 6, 1), 4.0), (1, 1, DAY(2026, 6, 30), 5.0), (1, 1, DAY(2026, 12, 1), 100.0), (1, 1, None, 100.0), (2, 1, DAY(2026, 6, 1), 100.0)],
        "order_id long, part_id long, need_by_date date, order_qty double",
    )
    work = spark.createDataFrame([(1, 6.0, "released", DAY(2026, 7, 1), None), (1, 50.0, "closed", None, DAY(2026, 6, 12))], "part_id long, quantity double, status string, required_date date, close_date date")
    po = spark.createDataFrame([], "po_id long, status string, required_date date")
    po_line = spark.createDataFrame([], "po_id long, part_id long, quantity double")
    rows = planning.time_phased_atp(parts, orders, lines, work, po_line, po).orderBy("bucket_index").collect()
    assert [(r.bucket, r.gross_requirements, r.scheduled_receipts, r.atp_pab, r.atp_status) for r in rows] == [
        ("Past Due", 3.0, 0.0, 7.0, "AVAILABLE"), ("M0", 9.0, 0.0, -2.0, "SHORT"), ("M1", 0.0, 6.0, 4.0, "AVAILABLE"), ("M2", 0.0, 0.0, 4.0, "AVAILABLE"),
        ("M3", 0.0, 0.0, 4.0, "AVAILABLE"), ("M4", 0.0, 0.0, 4.0, "AVAILABLE"), ("M5", 0.0, 0.0, 4.0, "AVAILABLE"),
    ]


def test_netting_equals_the_loop(spark):
    random.seed(5)
    rows, want = [], {}
    for p in range(60):
        on_hand, safety, lead = float(random.randint(0, 20)), float(random.randint(0, 8)), random.choice([1, 20, 45, 400])
        pab = on_hand
        for b in range(10):
            gross, fc, sched = (float(random.choice([0, 0, random.randint(1, 15)])) for _ in range(3))
            rows.append((p, b, on_hand, safety, lead, gross, fc, sched))
            need = max(gross, fc)
            without = pab + sched - need
            net = max(0.0, safety - without) if need > 0 else 0.0
            pab = without + net
            want[p, b] = (pab, net)
    inputs = spark.createDataFrame(rows, "part_id long, bucket_index int, on_hand_qty double, safety_stock double, lead_time_days long, co double, fc double, sched double")
    start = spark.createDataFrame([(DAY(2026, 6, 1),)], "plan_start date")
    got = planning.netting_grid(inputs, start).collect()
    assert {(r.part_id, r.bucket_index): (r.projected_balance, r.net_requirement) for r in got} == want
    assert sum(r.planned_release for r in got) == pytest.approx(sum(r.net_requirement for r in got))


def demand(spark):
    """Parts with and without demand, lead time and supply; the plan starts on 2026-06-01."""
    parts = part(spark, [(k, "a", "RAW", "EA", 1.0, lead, 0.0, on_hand, 0.0, active) for k, lead, on_hand, active in [(1, None, 0.0, 1), (2, 5, 0.0, 1), (3, 5, 0.0, 1), (4, 0, 0.0, 1), (5, 5, 0.0, 1), (6, 5, 9.0, 0), (7, 5, 0.0, 1), (8, 5, None, 1)]])
    orders = spark.createDataFrame([(1, DAY(2026, 1, 1), "Open"), (2, DAY(2026, 1, 1), "Closed")], "order_id long, order_date date, status string")
    lines = spark.createDataFrame(
        [(1, 1, DAY(2026, 6, 5), 3.0, None), (1, 2, DAY(2026, 6, 1), 4.0, 1.0), (1, 2, DAY(2027, 2, 28), 1.0, 3.0), (1, 4, DAY(2026, 5, 31), 9.0, None), (1, 5, DAY(2027, 3, 1), 9.0, None), (2, 4, DAY(2026, 7, 1), 9.0, None), (1, 6, DAY(2026, 7, 1), 2.0, None), (1, 4, None, 2.0, None)],
        "order_id long, part_id long, need_by_date date, order_qty double, shipped_qty double",
    )
    forecast = spark.createDataFrame([(3, DAY(2026, 8, 1), 5.0), (3, DAY(2026, 5, 1), 50.0), (2, DAY(2026, 8, 1), 2.0), (5, DAY(2026, 8, 1), 0.0), (99, DAY(2026, 8, 1), 1.0), (8, DAY(2026, 8, 1), 1.0)], "part_id long, forecast_date date, forecast_qty double")
    work = spark.createDataFrame([(7, 50.0, "closed", None, DAY(2026, 6, 12)), (3, 1.0, "released", DAY(2026, 6, 1), None), (2, 1.0, "released", DAY(2026, 5, 31), None), (2, 1.0, "firmed", DAY(2027, 3, 1), None)], "part_id long, quantity double, status string, required_date date, close_date date")
    po, po_line = spark.createDataFrame([(1, "Open", DAY(2026, 9, 1))], "po_id long, status string, required_date date"), spark.createDataFrame([(1, 8, 2.0)], "po_id long, part_id long, quantity double")
    return parts, orders, lines, forecast, work, po, po_line


def test_parts_with_demand_in_the_horizon(spark):
    """Past-due lines and those after the horizon aren't demand; parts without a lead time and inactive ones are listed."""
    parts, orders, lines, forecast, work, *_ = demand(spark)
    got = {r.part_id: (r.demand_lines, r.demand_qty) for r in planning.planning_parts(parts, orders, lines, forecast, work).collect()}
    assert got == {1: (1, 3.0), 2: (2, 5.0), 3: (0, 5.0), 6: (1, 2.0), 8: (0, 1.0)}


def test_bad_inputs_fail_closed(spark):
    """One row a part with demand; a bad lead time comes first; receipts must be due in the horizon; a part without demand has none."""
    parts, orders, lines, forecast, work, po, po_line = demand(spark)
    rows, receipts = planning.planning_parts(parts, orders, lines, forecast, work), planning.scheduled_receipts(work, po_line, po)
    got = [(r.part_id, r.problem.split()[0]) for r in planning.planning_problems(rows, receipts, work).orderBy("part_id").collect()]
    assert got == [(1, "missing"), (2, "no")]
    with pytest.raises(ValueError, match="part 1: missing"):
        planning.planning_problems(rows, receipts, work, strict=True)
    assert planning.planning_problems(rows.where("part_id > 2"), receipts, work, strict=True).count() == 0


def test_past_forecasts_are_past_due_demand(spark):
    parts, orders, lines, forecast, work, po, po_line = demand(spark)
    inputs = planning.netting_inputs(parts, orders, lines, forecast, work, po_line, po)
    assert {(r.bucket_index, r.fc) for r in inputs.where("part_id = 3 and fc > 0").collect()} == {(0, 50.0), (3, 5.0)}
    grid = {r.bucket_index: r for r in planning.netting_grid(inputs, planning.plan_start(work)).where("part_id = 3").collect()}
    assert (grid[0].gross_requirements, grid[0].net_requirement, grid[3].gross_requirements) == (50.0, 50.0, 5.0)


def test_over_receipt_never_offsets_a_short_line(spark):
    po = spark.createDataFrame([(1, 9, "Open")], "po_id long, supplier_id long, status string")
    lines = spark.createDataFrame([(1, 11, 10.0), (1, 12, 10.0)], "po_id long, line_id long, quantity double")
    got = spark.createDataFrame([(11, 25.0, DAY(2026, 1, 1)), (12, 4.0, DAY(2026, 1, 2))], "po_line_id long, quantity_received double, receipt_date date")
    row = purchasing.short_orders(po, lines, got).first()
    assert (row.lines_short, row.lines_unreceived, row.qty_outstanding) == (1, 0, 6.0)
    assert purchasing.fully_received(po, lines, got).count() == 0


def test_posting_twice_posts_once(spark):
    events = spark.createDataFrame([(1, 7, "RM_ISSUE", 5.0, DAY(2026, 1, 1), "doc", 1), (2, 7, "LABOR", 0.0, DAY(2026, 1, 1), "doc", 2), (3, 7, "LABOR", 4.0, None, "doc", 3)], "event_id long, job_id long, event_type string, amount double, event_date date, source_table string, source_id long")
    lines = ledger.post(events.union(events))
    assert sorted((r.ledger, r.amount) for r in lines.collect()) == [("RM", -5.0), ("WIP", 5.0)]
    assert ledger.post(events, lines).count() == 0


def test_mask_passes_null_and_empty_and_needs_salt(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "v string")
    masked = [r[0] for r in df.select(cleansing.hash_mask(df.v, "s", 8)).collect()]
    assert masked[:2] == [None, ""] and len(masked[2]) == 8 and masked[2] == masked[2].upper()
    with pytest.raises(ValueError):
        cleansing.hash_mask(df.v, "")


def test_cycle_raises(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    with pytest.raises(ValueError):
        graph.explode_hierarchy(edges, 1, max_depth=5)


def test_three_way_match_guards(spark):
    """A line whose receipts are all outside of the window has no row; one without a receipt has; a late voucher doesn't cover."""
    po = spark.createDataFrame([(1, 9, "Open", "S1"), (2, 8, "Open", "S1"), (3, 9, "Cancelled", "S1")], "po_id long, supplier_id long, status string, site_id string")
    lines = spark.createDataFrame([(11, 1, 5, 10.0), (12, 1, 5, 10.0), (13, 1, 5, 4.0), (21, 2, 5, 1.0), (31, 3, 5, 1.0)], "line_id long, po_id long, part_id long, quantity double")
    who = spark.createDataFrame([(9, "nine")], "supplier_id long, supplier_name string")
    got = spark.createDataFrame([(110, 11, 10.0, DAY(2026, 1, 5)), (111, 11, 2.0, DAY(2026, 3, 1)), (120, 12, 10.0, DAY(2026, 3, 5))], "receipt_line_id long, po_line_id long, quantity_received double, receipt_date date")
    bills = spark.createDataFrame([(1, 110, 77, 10.0), (2, 111, 78, 5.0), (3, 120, 79, 1.0)], "payable_line_id long, receipt_line_id long, invoice_id long, qty double")
    papers = spark.createDataFrame([(77, "Open", DAY(2026, 2, 1)), (78, "Cancelled", DAY(2026, 3, 2))], "invoice_id long, status string, invoice_date date")
    run = lambda **x: {(r.line_id, r.receipt_line_id, r.match_status, r.qty_invoiced, r.invoice_document_exists) for r in purchasing.three_way_match(po, lines, who, got, bills, papers, **x).collect()}
    open_lines = {(13, None, "Not Received", 0.0, 0), (21, None, "Not Received", 0.0, 0)}
    assert run() == open_lines | {(11, 110, "Matched", 10.0, 1), (11, 111, "Received-Uninvoiced", 0.0, 1), (12, 120, "Partially Invoiced", 0.0, 0)}
    assert run(end="2026-01-31") == open_lines | {(11, 110, "Received-Uninvoiced", 0.0, 1)}
    assert run(start="2026-03-02") == open_lines | {(12, 120, "Partially Invoiced", 0.0, 0)}
    assert run(supplier=8) == {(21, None, "Not Received", 0.0, 0)}
