"""Registered purchasing queries."""

from millrace.operators import purchasing as op

from .define import Registry, cents_sql, exact_sum

plans = Registry()
add = plans.add
AP = "with n as (select max(invoice_date) as d from {payables}), x as (select p.*, date_diff('day', due_date, n.d) as late from {payables} p, n) "
GOT = "(select po_line_id, sum(quantity_received) as got, max(receipt_date) as last from {receiving_line} group by 1)"
LINES = f"(select o.po_id, o.supplier_id, o.status, l.quantity as q, coalesce(got, 0) as g, last from {{purchase_order}} o join {{po_line}} l on l.po_id = o.po_id left join {GOT} r on r.po_line_id = l.line_id where o.status <> 'Cancelled')"
LIVE = "{payable_line} v join {payables} p on p.invoice_id = v.invoice_id and p.status <> 'Cancelled'"

add("d01_supplier_master", lambda t: op.supplier_master(t["suppliers"]), "select supplier_id, supplier_name, category, certification_level, payment_terms, lead_time_days, if(outside_service = 1, 'Yes', 'No') as outside_service from {suppliers} where active = 1")
add("d02_outside_service", lambda t: op.outside_service(t["suppliers"]), "select supplier_id, supplier_name, certification_level, payment_terms, lead_time_days from {suppliers} where active = 1 and outside_service = 1")
add("d03_delivery_scorecard", lambda t: op.delivery_scorecard(t["suppliers"], t["delivery"]), f"""
  select s.supplier_id, s.supplier_name, count(d.delivery_id) as deliveries, round(avg(ontime_rate) * 100, 4) as ontime_pct, {cents_sql('avg(quality_score) * 100', 4)} as quality_pct,
    count(*) filter (ontime_rate >= 0.95) as excellent, count(*) filter (ontime_rate < 0.8) as late, round(count(*) filter (ontime_rate < 0.8) / nullif(count(d.delivery_id), 0), 4) as late_rate
  from {{suppliers}} s left join {{delivery}} d on d.supplier_id = s.supplier_id group by 1, 2""")
add("d04_late_penalties", lambda t: op.late_penalties(t["delivery"]), "select supplier_id, actual_quantity, count(*) as late_deliveries, round(count(*) * actual_quantity * 0.02e0, 4) as penalty from {delivery} where ontime_rate < 0.8 group by 1, 2")
add("d05_exposure_estimate", lambda t: op.exposure_estimate(t["suppliers"], t["delivery"], t["erp_part"]), """
  with x as (select d.supplier_id, sum(actual_quantity) as u, round(avg(ontime_rate), 4) as o, round(avg(quality_score), 4) as q from {delivery} d join {suppliers} s on s.supplier_id = d.supplier_id group by 1)
  select supplier_id, u as units, round(u * (select round(avg(unit_cost), 4) from {erp_part}), 2) as exposure,
    if(o >= 0.95 and q >= 0.95, 'Early-Pay Eligible', if(o < 0.8 or q < 0.85, 'Hold — Review Required', 'Standard Terms')) as payment_terms from x""")
add("d06_ap_total_due", lambda t: op.ap_total_due(t["payables"]), AP + f"""
  select supplier_id, {exact_sum('amount_dollars', "status in ('Open', 'Disputed')")} as total_due, {exact_sum('amount_dollars', "status = 'Disputed'")} as disputed,
    {exact_sum('amount_dollars', "status in ('Open', 'Disputed') and late > 0")} as overdue from x group by 1""")
add("d07_ap_aging", lambda t: op.ap_aging(t["payables"]), AP + f"""
  select supplier_id, {exact_sum('amount_dollars', "late <= 0")} as current, {exact_sum('amount_dollars', "late between 1 and 30")} as days_1_30,
    {exact_sum('amount_dollars', "late between 31 and 60")} as days_31_60, {exact_sum('amount_dollars', "late between 61 and 90")} as days_61_90,
    {exact_sum('amount_dollars', "late > 90")} as over_90 from x where status in ('Open', 'Disputed') group by 1""")
add("d08_open_orders_by_supplier", lambda t: op.open_orders_by_supplier(t["suppliers"], t["purchase_order"]), """
  select s.supplier_id, supplier_name, certification_level, count(*) as open_po_count, round(sum(total_cost), 2) as total_open_value from {suppliers} s join {purchase_order} o on o.supplier_id = s.supplier_id and o.status in ('Open', 'Received') group by 1, 2, 3""")
add("d08_delivery_status", lambda t: op.delivery_status(t["purchase_order"], t["receiving_line"]), """
  with n as (select max(receipt_date) as d from {receiving_line}), r as (select po_id, max(receipt_date) as last from {receiving_line} group by 1)
  select o.po_id, supplier_id, status as po_status, cast(last as varchar) as last_receipt_date,
    case when last > required_date then 'Late' when last is not null then 'On Time' when status in ('Cancelled', 'Closed') then 'N/A' when n.d > required_date then 'Overdue — No Receipt' else 'Open — Pending' end as delivery_status
  from {purchase_order} o cross join n left join r on r.po_id = o.po_id""")
add("d09_fully_received", lambda t: op.fully_received(t["purchase_order"], t["po_line"], t["receiving_line"]), f"""
  select po_id, supplier_id, status, count(*) as lines, round(sum(q), 1) as qty_ordered, round(sum(g), 1) as qty_received, cast(max(last) as varchar) as last_receipt_date from {LINES} x group by 1, 2, 3 having count(*) filter (g < q) = 0""")
add("d10_short_orders", lambda t: op.short_orders(t["purchase_order"], t["po_line"], t["receiving_line"]), f"""
  select po_id, supplier_id, status, count(*) as lines, count(*) filter (g <= 0) as lines_unreceived, count(*) filter (g > 0 and g < q) as lines_short, round(sum(greatest(q - g, 0)), 1) as qty_outstanding from {LINES} x group by 1, 2, 3 having count(*) filter (g < q) > 0""")
accrual = lambda t: op.partial_receipt_accrual(t["purchase_order"], t["po_line"], t["receiving_line"], t["payable_line"], t["payables"])
add("d11_uninvoiced_receipts", lambda t: op.uninvoiced_receipts(t["receiving_line"], t["payable_line"], t["payables"], end="2000-12-31"), f"""
  select receipt_id, po_id, supplier_id, count(*) as open_lines, cast(max(receipt_date) as varchar) as received_date from {{receiving_line}} r
  where receipt_date <= date '2000-12-31' and quantity_received > coalesce((select sum(abs(qty)) from {LIVE} where v.receipt_line_id = r.receipt_line_id and invoice_date <= date '2000-12-31'), -1) group by 1, 2, 3""")
add("d12_partial_receipt_accrual", lambda t: accrual(t.kept("po_line")), f"""
  with b as (select po_line_id, sum(abs(qty)) as q from {LIVE} group by 1),
  x as (select l.*, got, last, coalesce(b.q, 0) as inv from {{po_line}} l join {GOT} r on r.po_line_id = l.line_id left join b on b.po_line_id = l.line_id)
  select x.po_id, line_id, part_id, o.supplier_id, round(quantity, 1) as qty_ordered, round(got, 1) as qty_received, round(inv, 1) as qty_invoiced, round(got - inv, 1) as qty_uninvoiced,
    cast(round(cast((got - inv) * unit_cost as decimal(28, 8)), 2) as double) as accrued_value, cast(last as varchar) as last_receipt_date
  from x join {{purchase_order}} o on o.po_id = x.po_id and o.status <> 'Cancelled' where got > 0 and got < quantity and inv < got""")


def match(t, **bounds):
    t = t.kept("po_line")
    return op.three_way_match(t["purchase_order"], t["po_line"], t["suppliers"], t["receiving_line"], t["payable_line"], t["payables"], **bounds)


def match_sql(supplier: str = "null", start: str = "null", end: str = "null") -> str:
    """The report with its guards; a null parameter is no filter."""
    return f"""(
  select o.po_id, l.line_id, l.part_id, o.supplier_id, s.supplier_name as vendor_name, o.site_id, round(l.quantity, 1) as qty_ordered, if(r.receipt_line_id is null, 0, 1) as receipt_exists, if(v.payable_line_id is null, 0, 1) as voucher_exists,
    if(p.invoice_id is null, 0, 1) as invoice_document_exists, r.receipt_line_id, v.payable_line_id, round(coalesce(r.quantity_received, 0), 1) as qty_received, cast(r.receipt_date as varchar) as received_date, v.invoice_id, cast(p.invoice_date as varchar) as invoice_date,
    p.status as voucher_status, round(case when v.payable_line_id is not null and p.status <> 'Cancelled' and ({end} is null or p.invoice_date <= {end}) then abs(v.qty) else 0 end, 1) as qty_invoiced,
    case when r.receipt_line_id is null then 'Not Received' when v.payable_line_id is null or p.status = 'Cancelled' or not ({end} is null or p.invoice_date <= {end}) then 'Received-Uninvoiced'
      else case sign(abs(v.qty) - r.quantity_received) when -1 then 'Partially Invoiced' when 0 then 'Matched' else 'Over-Invoiced' end end as match_status
  from {{purchase_order}} o join {{po_line}} l on l.po_id = o.po_id left join {{suppliers}} s on s.supplier_id = o.supplier_id left join {{receiving_line}} r on r.po_line_id = l.line_id
  left join {{payable_line}} v on v.receipt_line_id = r.receipt_line_id left join {{payables}} p on p.invoice_id = v.invoice_id
  where o.status <> 'Cancelled' and ({supplier} is null or s.supplier_id = {supplier}) and ({start} is null or r.receipt_line_id is null or r.receipt_date >= {start}) and ({end} is null or r.receipt_line_id is null or r.receipt_date <= {end}))"""


MATCH = match_sql()
add("d13_three_way_match", match, "select * from " + MATCH)
add("d13_match_in_window", lambda t: match(t, start="1994-01-01", end="1996-06-30"), "select * from " + match_sql(start="date '1994-01-01'", end="date '1996-06-30'"))
add("d13_match_of_supplier", lambda t: match(t, supplier=3, end="1996-06-30"), "select * from " + match_sql(supplier="3", end="date '1996-06-30'"))
add("d13_match_exceptions", lambda t: op.match_exceptions(match(t)), f"select supplier_id, match_status, count(*) as lines, round(sum(qty_invoiced - qty_received), 2) as qty_gap from {MATCH} x where match_status in ('Partially Invoiced', 'Over-Invoiced') group by 1, 2")
add("d16_daily_deliveries", lambda t: op.daily_deliveries(t["delivery"]), """
  with x as (select cast(delivery_date as varchar) as delivery_date, count(*) as deliveries, sum(if(ontime_rate >= 1, actual_quantity, 0)) as a, sum(if(ontime_rate < 1, actual_quantity, 0)) as b from {delivery} group by 1)
  select delivery_date, deliveries, a as qty_on_time, b as qty_late, round(100 * a / (a + b), 4) as on_time_pct from x""")
add("d17_supplier_exposure", lambda t: op.supplier_exposure(t["delivery"]), "select supplier_id, count(distinct part_id) as parts, round(100 * count(distinct part_id) / (select count(distinct part_id) from {delivery}), 4) as pct_of_parts from {delivery} group by 1")
add("d17_single_source_parts", lambda t: op.single_source_parts(t["delivery"]), "select part_id, min(supplier_id) as supplier_id, count(*) as deliveries from {delivery} group by 1 having count(distinct supplier_id) = 1")
add("d18_supplier_rating", lambda t: op.supplier_rating(t["suppliers"], t["delivery"]), """
  select s.supplier_id, round(coalesce(least(greatest(5 * (0.55e0 * avg(ontime_rate) + 0.45e0 * avg(quality_score)), 1), 5), 3), 4) as rating from {suppliers} s left join {delivery} d on d.supplier_id = s.supplier_id group by 1""")
add("d19_monthly_finance", lambda t: op.monthly_finance(t["delivery"]), """
  select strftime(delivery_date, '%Y-%m') as month, count(*) as deliveries, round(100 * count(*) filter (ontime_rate < 1) / count(*), 4) as late_pct, round(sum(if(ontime_rate < 1, actual_quantity * 15, 0)), 2) as penalty from {delivery} group by 1""")
add("d20_windowed_scorecard", lambda t: op.windowed_scorecard(t["delivery"], 365, 5), f"""
  select supplier_id, count(*) as deliveries, {cents_sql('avg(ontime_rate)', 4)} as avg_ontime, {cents_sql('avg(quality_score)', 4)} as avg_quality, count(*) filter (quality_score >= 0.95) as excellent, count(*) filter (quality_score < 0.94) as poor
  from {{delivery}} where delivery_date >= (select max(delivery_date) - 365 from {{delivery}}) group by 1 having count(*) >= 5""")
add("d21_unmatched_receivers", lambda t: op.unmatched_receivers(t["receiving_line"], t["payable_line"]), "select receipt_line_id, po_id, supplier_id, round(quantity_received, 2) as quantity_received from {receiving_line} where receipt_line_id not in (select receipt_line_id from {payable_line})")
QUERIES, ORACLES = plans.queries, plans.oracles
