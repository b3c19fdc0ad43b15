"""Registered audits, month-end checks, tickets, relief and payment matching."""

from millrace.operators import ledger, reconcile as op
from pyspark.sql import functions as F

from .define import Registry
from .ledger import COSTS, LINES

plans = Registry()
add = plans.add
WIP = "sum(cast(amount as decimal(18, 2)))"


def lines(t):
    return ledger.post(t["gl_events"])


integrity = lambda t: op.match_integrity(t["purchase_order"], t["po_line"], t["receiving"], t["receiving_line"], t["matched_payables"], t["payable_line"])
add("v02_match_integrity", lambda t: integrity(t.kept("po_line", "purchase_order", "receiving", "matched_payables")), """
  with l as (select l.*, r.quantity_received from {payable_line} l left join {receiving_line} r on r.receipt_line_id = l.receipt_line_id)
  select 'closed order not received' as check_name, count(*) as violations from {po_line} p join {purchase_order} o on o.po_id = p.po_id and o.status = 'Closed' where not exists (select 1 from {receiving_line} r where r.po_line_id = p.line_id and r.quantity_received >= p.quantity)
  union all select 'receipt header differs', count(*) from {receiving} h join (select receipt_id, sum(quantity_received) as q from {receiving_line} group by 1) r on r.receipt_id = h.receipt_id where abs(h.quantity_received - q) > 0.005
  union all select 'receipt without lines', count(*) from {receiving} h where not exists (select 1 from {receiving_line} r where r.receipt_id = h.receipt_id)
  union all select 'invoice differs from its lines', count(*) from {matched_payables} p where abs(amount_dollars - coalesce((select sum(cast(x.amount as decimal(18, 2))) from {payable_line} x where x.invoice_id = p.invoice_id), 0)) > 0.01
  union all select 'matched line unlinked or short', count(*) from l join {matched_payables} p on p.invoice_id = l.invoice_id and p.match_status = 'Matched' where l.receipt_line_id is null or quantity_received < qty
  union all select 'exception without mismatch', count(*) from {matched_payables} p where match_status = 'Exception' and exists (select 1 from l where l.invoice_id = p.invoice_id) and not exists (select 1 from l where l.invoice_id = p.invoice_id and quantity_received < qty)
  union all select 'paid but pending', count(*) from {matched_payables} where status = 'Paid' and match_status = 'Pending'
  union all select 'dangling payable line', count(*) from {payable_line} where receipt_line_id is not null and receipt_line_id not in (select receipt_line_id from {receiving_line})
  union all select 'dangling receiving line', count(*) from {receiving_line} where po_line_id not in (select line_id from {po_line})
  union all select 'dangling receipt', count(*) from {receiving} where po_id not in (select po_id from {purchase_order})""")

add("l09_month_end_checks", lambda t: op.month_end(lines(t), t["material_issue"], t["labor_ticket"], t["job"], "2024-01-20"), f"""
  with d as (select date '2024-01-20' as as_of), x as (select l.* from {LINES} l, d where event_date <= as_of),
  mi as (select coalesce(sum(cast(total_cost as decimal(18, 2))), 0) as v from {{material_issue}}, d where issue_date <= as_of), la as (select coalesce(sum(cast(labor_cost + burden_cost as decimal(18, 2))), 0) as v from {{labor_ticket}}, d where clock_out <= as_of),
  cl as (select job_id, act_cost from {{job}}, d where status = 'closed' and close_date <= as_of), done as (select coalesce(sum(cast(act_cost as decimal(18, 2))), 0) as v from cl),
  w as (select coalesce({WIP}, 0) as v from x where ledger = 'WIP'), rm as (select coalesce(-{WIP}, 0) as v from x where ledger = 'RM' and amount < 0), fg as (select coalesce({WIP}, 0) as v from x where ledger = 'FG'),
  j as (select x.job_id, {WIP} as b, sum(cast(greatest(amount, 0) as decimal(18, 2))) as i, count(*) filter (amount < 0) as o, x.job_id in (select job_id from cl) as c from x where ledger = 'WIP' and x.job_id in (select job_id from {{job}}) group by 1),
  r as (
    select 'WIP is inflows less completions' as check_name, cast(w.v as double) as lhs, cast(mi.v + la.v - done.v as double) as rhs from w, mi, la, done
    union all select 'raw material outflow is issues', cast(rm.v as double), cast(mi.v as double) from rm, mi union all select 'finished goods are closed jobs', cast(fg.v as double), cast(done.v as double) from fg, done
    union all select 'closed jobs without WIP', cast(count(*) filter (c and abs(b) > 0.005) as double), 0 from j union all select 'open jobs carry their inflows', cast(count(*) filter (not c and abs(b - i) > 0.005) as double), 0 from j
    union all select 'no outflow before closing', cast(coalesce(sum(o) filter (not c), 0) as double), 0 from j)
  select check_name, lhs, rhs, abs(lhs - rhs) < 0.01 as ok from r union all select 'window has events', cast(count(*) as double), 1, count(*) > 0 from x""")
add("l11_lifecycle_violations", lambda t: op.lifecycle_violations(t["status_change"], t["gl_events"]), f"""
  with c as (select job_id, sum(amount) as cost from {{gl_events}} where {COSTS} group by 1), s as (select s.*, coalesce(cost, 0) as cost from {{status_change}} s left join c on c.job_id = s.job_id where from_status is not null and from_status <> to_status)
  select change_id, job_id, from_status, to_status, 'illegal step' as rule from s where from_status || '>' || to_status not in ('unreleased>firmed', 'unreleased>released', 'firmed>released', 'released>closed')
  union all select change_id, job_id, from_status, to_status, 'planned order completed' from s where planned and to_status = 'closed'
  union all select change_id, job_id, from_status, to_status, 'completed without cost' from s where to_status = 'closed' and cost <= 0""")
HOURS = "cast(round(cast(act_lab_cost / nullif(if(r.resource_id % 7 = 3, 0, run_cost_per_hr), 0) as decimal(28, 8)), 2) as double)"
rated = lambda t: t["shop_resource"].withColumn("run_cost_per_hr", F.when(F.col("resource_id") % 7 == 3, 0.0).otherwise(F.col("run_cost_per_hr")))
TICKETS = f"(select o.*, bur_per_hr_run, {HOURS} as hours from {{operation}} o left join {{shop_resource}} r on r.resource_id = o.resource_id where act_lab_cost > 0)"
add("l14_labor_tickets", lambda t: op.labor_tickets(t["operation"], rated(t))[0], f"""
  select wo_id, sequence_no, resource_id, hours, cast(round(cast(act_lab_cost as decimal(28, 8)), 2) as double) as labor_cost, cast(round(cast(hours * bur_per_hr_run as decimal(28, 8)), 2) as double) as burden_cost,
    strftime(cast(sched_start_date as timestamp) + interval 8 hour, '%Y-%m-%d %H:%M:%S') as clock_in, strftime(cast(sched_start_date as timestamp) + interval 8 hour + to_seconds(cast(round(hours * 3600) as bigint)), '%Y-%m-%d %H:%M:%S') as clock_out
  from {TICKETS} x where hours > 0""")
add("l14_ticket_problems", lambda t: op.labor_tickets(t["operation"], rated(t))[1], f"select wo_id, sequence_no, if(hours is null, 'no rate', 'zero hours') as problem from {TICKETS} x where hours is null or hours <= 0")
add("l15_shipment_relief", lambda t: ledger.post(op.shipment_relief(lines(t), F.lit("2024-08-01").cast("date"))).withColumn("event_date", F.col("event_date").cast("string")), f"""
  select job_id as event_id, job_id, 'CUSTOMER_SHIPMENT' as event_type, '2024-08-01' as event_date, 'customer_order_line' as source_table, job_id as source_id, 'FG' as ledger, cast(-{WIP} as double) as amount
  from {LINES} x where event_type = 'FG_COMPLETION' and ledger = 'FG' group by job_id having {WIP} > 0""")
add("v10_missing_related", lambda t: op.missing_related(t["operation_text"], ["wo_id", "sequence_no"], "type_text", "own_text"), "select wo_id, sequence_no, type_text from {operation_text} where trim(coalesce(type_text, '')) <> '' and trim(coalesce(own_text, '')) = ''")
PART = "case when reference like '%,%' then trim(string_split(reference, ',')[{}]) end"
add("d23_remittance_classes", lambda t: op.remittance_classes(t["remittance"], t["invoice_reference"]), f"""
  with p as (select *, {PART.format(1)} as l, {PART.format(-1)} as r from {{remittance}}), w as (select * from p where l is null and reference <> 'NO PO'), i as (select * from {{invoice_reference}}),
  one as (select payment_id, invoice_id, '1' as match_class from w join i on packlist_id = reference and abs(w.amount - i.amount) < 0.005), oneb as (select payment_id, invoice_id, '1B' as match_class from w join i on order_ref = reference and abs(w.amount - i.amount) < 0.005),
  rest as (select * from w where payment_id not in (select payment_id from one union all select payment_id from oneb)), two as (select payment_id, invoice_id, '2' as match_class from rest join i on packlist_id = reference),
  three as (select payment_id, invoice_id, '3' as match_class from p join i on packlist_id = r), four as (select payment_id, invoice_id, '4' as match_class from p join i on packlist_id = l),
  hit as (select payment_id from two union all select payment_id from three union all select payment_id from four), none as (select payment_id from rest union all select payment_id from p where l is not null)
  select * from one union all select * from oneb union all select * from two union all select * from three union all select * from four
  union all select payment_id, null, '5' from none where payment_id not in (select payment_id from hit) union all select payment_id, null, '6' from p where reference = 'NO PO'""")
chain = lambda t: op.procure_to_pay(t["po_line"], t["receiving_line"], t["payable_line"], t["payables"], t["suppliers"], t["erp_part"])
add("d25_procure_to_pay", lambda t: chain(t.kept("po_line")), """
  select distinct p.line_id, p.po_id, supplier_name, part_description, p.quantity, r.receipt_line_id, quantity_received, payable_line_id, qty as invoiced_qty, y.status as payable_status
  from {po_line} p left join {receiving_line} r on r.po_line_id = p.line_id left join {payable_line} b on b.receipt_line_id = r.receipt_line_id left join {payables} y on y.invoice_id = b.invoice_id
  left join {suppliers} s on s.supplier_id = p.supplier_id left join {erp_part} e on e.part_id = p.part_id""")
QUERIES, ORACLES = plans.queries, plans.oracles
