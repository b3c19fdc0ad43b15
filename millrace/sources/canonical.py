"""The canonical ERP tables, derived from the shared star schema by one SQL text each.

`Tables` gives them to operators as lazy DataFrames; `with_clause` gives the same definitions to a SQL oracle. Dates are
ISO text where operators compare them as text, and DATE columns else. Both dialects run the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.lineage import cut, deal

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: name -> SQL over {star table} or {canonical table}.
CANONICAL: dict[str, str] = {
    "erp_part": """
        select p_partkey as part_id, p_name as part_description, p_type as part_class, 'EA' as unit_of_measure, p_retailprice as unit_cost,
          cast(p_size as bigint) as lead_time_days, cast((p_partkey * 13) % 150 as double) as reorder_point,
          cast((p_partkey * 37) % 400 as double) as on_hand_qty, cast(1 as double) as safety_stock, 1 as active
        from {part}""",
    "order_line": """
        select l_orderkey as order_id, l_linenumber as line_no, min(l_partkey) as part_id, min(l_suppkey) as supplier_id,
          sum(l_quantity) as quantity, round(sum(l_extendedprice), 2) as amount, min(l_discount) as discount, min(l_tax) as tax,
          min(l_returnflag) as return_flag, min(l_linestatus) as line_status, cast(min(l_shipdate) as date) as ship_date
        from {lineitem} group by l_orderkey, l_linenumber""",
    "customer_order": """
        select o_orderkey as order_id, o_custkey as customer_id, cast(o_orderdate as date) as order_date, o_totalprice as total_price,
          case o_orderstatus when 'O' then 'Open' when 'P' then 'Shipped' else 'Closed' end as status
        from {orders}""",
    "customer_order_line": """
        select order_id * 10 + line_no as order_line_id, order_id, line_no, part_id, quantity as order_qty, amount / quantity as unit_price,
          ship_date as need_by_date, case when line_status = 'F' then quantity / 2 end as shipped_qty
        from {order_line}""",
    "work_order": """
        select l.order_id * 10 + l.line_no as wo_id, l.part_id, l.quantity, case when o.status = 'Shipped' then 'released' else 'closed' end as status,
          o.order_date as open_date, case when o.status = 'Shipped' then l.ship_date else o.order_date + 45 end as required_date,
          case when o.status = 'Closed' then l.ship_date end as close_date,
          cast(round(cast(l.amount * 0.30 as decimal(28, 8)), 2) as double) as act_lab_cost, cast(round(cast(l.amount * 0.20 as decimal(28, 8)), 2) as double) as act_bur_cost, cast(round(cast(l.amount * 0.05 as decimal(28, 8)), 2) as double) as act_ser_cost, cast(round(cast(l.amount * 0.25 as decimal(28, 8)), 2) as double) as act_mat_cost,
          case when l.return_flag = 'R' then 1 else 0 end as outside_service
        from {order_line} l join {customer_order} o on o.order_id = l.order_id
        where o.status = 'Shipped' or (o.status = 'Closed' and l.ship_date < date '1998-07-01')""",
    "suppliers": """
        select s_suppkey as supplier_id, s_name as supplier_name, cast(s_nationkey as varchar(10)) as category,
          case when s_acctbal > 5000 then 'AS9100' else 'ISO9001' end as certification_level, 'Net ' || cast(30 + (s_suppkey % 3) * 15 as varchar(10)) as payment_terms,
          cast(10 + s_suppkey % 50 as bigint) as lead_time_days, cast(s_suppkey % 2 as int) as outside_service, case when s_suppkey % 7 = 0 then 0 else 1 end as active
        from {supplier}""",
    "po_line": """
        select l.order_id * 10 + l.line_no as line_id, l.order_id * 1000 + l.supplier_id % 1000 as po_id, l.part_id, l.supplier_id, l.quantity, l.amount / l.quantity as unit_cost, l.amount,
          l.line_status, l.return_flag, l.discount, l.tax, l.ship_date, o.order_date
        from {order_line} l join {customer_order} o on o.order_id = l.order_id where o.status = 'Open'""",
    "purchase_order": """
        select po_id, min(supplier_id) as supplier_id, min(order_date) as po_date, min(order_date) + 60 as required_date, round(sum(amount), 2) as total_cost,
          case when po_id % 29 = 0 then 'Cancelled' when min(line_status) = 'O' then 'Open' when po_id % 5 = 0 then 'Closed' when po_id % 5 = 1 then 'Received' else 'Partial' end as status,
          case when po_id % 2 = 0 then 'material' else 'outside_service' end as po_type, 'SITE-1' as site_id
        from {po_line} group by po_id""",
    "receiving_line": """
        select line_id * 10 as receipt_line_id, po_id * 10 as receipt_id, po_id, line_id as po_line_id, part_id, supplier_id,
          case when return_flag = 'A' then quantity when line_id % 7 = 0 then quantity + 2 else quantity / 2 end as quantity_received, ship_date as receipt_date, discount, tax, return_flag, unit_cost
        from {po_line} where return_flag in ('A', 'R')""",
    "payable_line": """
        select receipt_line_id * 10 as payable_line_id, receipt_id * 10 as invoice_id, receipt_line_id, po_line_id, part_id, supplier_id,
          case when tax >= 0.07 then quantity_received + 1 when tax >= 0.05 then quantity_received / 2 else quantity_received end as qty,
          cast(round(cast(quantity_received * unit_cost as decimal(28, 8)), 2) as double) as amount
        from {receiving_line} where discount >= 0.02""",
    "payables": """
        select p.invoice_id, min(p.supplier_id) as supplier_id, min(r.receipt_date) + 5 as invoice_date, min(r.receipt_date) + 35 as due_date, round(sum(p.amount), 2) as amount_dollars,
          case when p.invoice_id % 17 = 0 then 'Cancelled' when p.invoice_id % 11 = 0 then 'Paid' when min(r.return_flag) = 'R' then 'Disputed' else 'Open' end as status
        from {payable_line} p join {receiving_line} r on r.receipt_line_id = p.receipt_line_id group by p.invoice_id""",
    "receivable": """
        select o_orderkey as invoice_id, o_custkey as customer_id, cast(o_orderdate as date) as invoice_date,
          case when o_orderkey % 23 = 0 then null else cast(o_orderdate as date) + 30 end as due_date, o_totalprice as amount_dollars,
          case when o_orderstatus = 'F' then 'Paid' else 'Open' end as status, case when o_orderstatus = 'F' then cast(o_orderdate as date) + 20 end as payment_date
        from {orders}""",
    "receivable_payment": """
        select order_id as invoice_id, line_no as installment_no, order_date + cast(10 * (line_no % 3) as int) as payment_date, amount
        from (select l.order_id, l.line_no, l.amount, o.order_date from {order_line} l join {customer_order} o on o.order_id = l.order_id where o.status <> 'Open') x""",
    "gl_events": """
        select event_id, user_id as job_id, case event_type when 'purchase' then 'RM_ISSUE' when 'click' then 'LABOR' when 'view' then 'BURDEN' when 'signup' then 'FG_COMPLETION' else 'CASH_RECEIPT' end as event_type,
          cast(round(cast(value as decimal(28, 8)), 2) as double) as amount, cast(ts as date) as event_date, 'events' as source_table, event_id as source_id
        from {events}""",
    "delivery": """
        select l.order_id * 10 + l.line_no as delivery_id, l.supplier_id, l.part_id, l.ship_date as delivery_date, l.quantity as planned_quantity,
          case when l.return_flag = 'R' then l.quantity / 2 else l.quantity end as actual_quantity,
          case when l.ship_date <= o.order_date + 400 then cast(1 as double) else cast(0.5 as double) end as ontime_rate, 1 - l.tax as quality_score
        from {order_line} l join {customer_order} o on o.order_id = l.order_id""",
    "shop_resource": """
        select cast(n_nationkey as bigint) as resource_id, n_name as description, case n_nationkey % 3 when 0 then 'M' when 1 then 'L' else 'S' end as resource_type,
          cast(20 + n_nationkey as double) as run_cost_per_hr, cast(10 + n_nationkey as double) as bur_per_hr_run, case when n_nationkey % 11 = 10 then 0 else 1 end as active
        from {nation}""",
    "operation": """
        select wo_id, cast(10 as bigint) as sequence_no, wo_id % 25 as resource_id, case when status = 'closed' then 'C' when wo_id % 3 = 0 then 'S' else 'Q' end as status,
          quantity / 8 as run_hrs, quantity / 16 as setup_hrs, case when status = 'closed' then quantity / 7 else 0.0 end as act_run_hrs, case when status = 'closed' then quantity / 15 else 0.0 end as act_setup_hrs,
          act_lab_cost, act_bur_cost, open_date as sched_start_date, required_date as sched_finish_date, close_date
        from {work_order}""",
    "inventory_transaction": """
        select l.order_id * 10 + l.line_no as transaction_id, l.part_id, l.supplier_id % 3 as site_id, case when l.return_flag = 'N' then 'O' else 'I' end as type,
          case l.return_flag when 'A' then 'R' when 'R' then 'A' else 'I' end as class, l.quantity, l.ship_date as trans_date
        from {order_line} l""",
    "ncm": """
        select order_id * 10 + line_no as ncm_id, 'type ' || cast(part_id % 7 as varchar(10)) as material_type, ship_date as detection_date,
          case order_id % 3 when 0 then 'Scrap' when 1 then 'Rework' else 'Use as is' end as disposition_status, quantity as quantity_affected, supplier_id % 40 as assigned_employee_id
        from {order_line} where return_flag = 'R'""",
    "corrective_action": """
        select ncm_id, 'action ' || cast(ncm_id % 5 as varchar(10)) as action_description, cast(ncm_id % 100 as double) / 100 as effectiveness_score, case when ncm_id % 2 = 0 then 'Closed' else 'Open' end as status
        from {ncm} where ncm_id % 3 = 0""",
    "employee": """
        select s_suppkey as employee_id, 'First' || cast(s_suppkey as varchar(10)) as first_name, 'Last' || cast(s_suppkey % 9 as varchar(10)) as last_name from {supplier} where s_suppkey < 35""",
    "quality_incident": """
        select event_id as incident_id, case when value > 80 then 'Critical' when value > 40 then 'Major' else 'Minor' end as severity_level, cast(ts as date) as incident_date, value / 8 as resolution_time_hours,
          cast(round(cast(value * 12 as decimal(28, 8)), 2) as double) as cost_impact
        from {events} where event_type = 'error'""",
    "equipment": """
        select cast(n_nationkey as bigint) as equipment_id, 'EQ ' || n_name as equipment_name from {nation}""",
    "equipment_metric": """
        select e.event_id as metric_id, q.equipment_id, q.equipment_name, cast(e.ts as date) as measurement_date, cast(70 + e.event_id % 30 as double) / 100 as availability_rate, cast(60 + e.user_id % 40 as double) / 100 as performance_rate,
          cast(90 + e.event_id % 10 as double) / 100 as quality_rate, cast(40 + e.event_id % 50 as double) / 100 as oee_score, cast(e.event_id % 17 as double) / 4 as downtime_hours
        from {events} e join {equipment} q on q.equipment_id = e.user_id % 25 where e.event_type = 'view'""",
    "downtime_event": """
        select event_id, cast(ts as date) as event_date, case user_id % 4 when 0 then 'Mechanical' when 1 then 'Electrical' when 2 then 'Setup' else 'Material' end as downtime_category, event_id % 240 as duration_minutes,
          event_id % 13 as production_loss_units, cast(round(cast(value * 3 as decimal(28, 8)), 2) as double) as cost_impact
        from {events} where event_type in ('error', 'signup')""",
    "failure_event": """
        select event_id as failure_id, user_id % 29 as equipment_id, cast(ts as date) as failure_date, cast(event_id % 31 as double) / 2 as downtime_hours, cast(100 + event_id % 900 as double) as repair_cost, cast(event_id % 500 as double) as mtbf_impact
        from {events} where event_type = 'error'""",
    "production_line": """
        select cast(r_regionkey as bigint) as line_id, 'Line ' || r_name as line_name, case when r_regionkey % 2 = 0 then 'Assembly' else 'Machining' end as line_type from {region}""",
    "production_schedule": """
        select wo_id as schedule_id, wo_id % 6 as line_id, open_date as planned_start, open_date + cast(wo_id % 3 as int) as actual_start, quantity as target_quantity, case when wo_id % 4 = 0 then quantity / 2 else quantity end as actual_quantity,
          cast(50 + wo_id % 50 as double) / 100 as efficiency_score
        from {work_order}""",
    "quality_cost": """
        select order_id * 10 + line_no as cost_id, case return_flag when 'R' then 'Internal failure' when 'A' then 'Appraisal' else 'Prevention' end as cost_category, 'sub ' || cast(part_id % 4 as varchar(10)) as cost_subcategory, ship_date as cost_date,
          cast(round(cast(amount * 0.01 as decimal(28, 8)), 2) as double) as cost_amount, quantity as units_affected, cast(1 + line_no as double) as cost_per_unit
        from {order_line}""",
    "defect_record": """
        select ncm_id as defect_id, case ncm_id % 4 when 0 then 'Critical' when 1 then 'Major' when 2 then 'Minor' else 'Cosmetic' end as severity_level, case when ncm_id % 6 = 0 then 0.0 else quantity_affected * 2.5 end as ncm_cost,
          case when ncm_id % 2 = 0 then 'Scrap' else 'Rework' end as cost_category, quantity_affected * 1.5 as repair_cost, quantity_affected * 0.5 as scrap_cost, case when ncm_id % 5 = 0 then 1 else 0 end as customer_impact_flag,
          case when ncm_id % 10 = 0 then ncm_id * 7 end as complaint_id, case when ncm_id % 5 = 0 then detection_date + 3 end as customer_notification_date, 'kind ' || cast(ncm_id % 8 as varchar(10)) as defect_type,
          'cause ' || cast(ncm_id % 11 as varchar(10)) as root_cause, cast(ncm_id % 100 as double) as quality_score
        from {ncm}""",
    "receiving": """
        select receipt_id, po_id + case when receipt_id % 101 = 0 then -5 else 0 end as po_id, case when receipt_id % 97 = 0 then sum(quantity_received) + 1 else sum(quantity_received) end as quantity_received
        from {receiving_line} group by receipt_id, po_id
        union all select -o_orderkey as receipt_id, -o_orderkey as po_id, 1.0 as quantity_received from {orders} where o_orderkey % 701 = 5""",
    "matched_payables": """
        select p.invoice_id, p.status, case when p.invoice_id % 43 = 0 then p.amount_dollars + 3 else p.amount_dollars end as amount_dollars,
          case when p.invoice_id % 13 = 0 then 'Pending' when p.invoice_id % 31 = 0 then 'Matched' when p.invoice_id % 37 = 0 then 'Exception' when x.short = 1 then 'Exception' else 'Matched' end as match_status
        from {payables} p join (select l.invoice_id, max(case when r.quantity_received < l.qty then 1 else 0 end) as short from {payable_line} l join {receiving_line} r on r.receipt_line_id = l.receipt_line_id group by l.invoice_id) x on x.invoice_id = p.invoice_id""",
    "material_issue": """
        select event_id as issue_id, user_id as job_id, cast(round(cast(value as decimal(28, 8)), 2) as double) as total_cost, cast(ts as date) as issue_date
        from {events} where event_type = 'purchase' and event_id % 211 <> 3""",
    "labor_ticket": """
        select event_id as ticket_id, user_id as job_id, case when event_type = 'click' then cast(round(cast(value as decimal(28, 8)), 2) as double) else 0.0 end as labor_cost,
          case when event_type = 'view' then cast(round(cast(value as decimal(28, 8)), 2) as double) else 0.0 end as burden_cost, cast(ts as date) as clock_out
        from {events} where event_type in ('click', 'view')""",
    "job": """
        select user_id as job_id, case when max(case when event_type = 'signup' then 1 else 0 end) = 1 and user_id % 3 > 0 then 'closed' else 'released' end as status, max(case when event_type = 'signup' then cast(ts as date) end) as close_date,
          cast(round(cast(sum(case when event_type = 'signup' then value else 0.0 end) as decimal(28, 8)), 2) as double) as act_cost
        from {events} group by user_id""",
    "status_change": """
        select event_id as change_id, user_id as job_id, user_id % 17 = 0 as planned, lag(state) over (partition by user_id order by ts, event_id) as from_status, state as to_status
        from (select event_id, user_id, ts, case event_type when 'view' then 'unreleased' when 'click' then 'firmed' when 'purchase' then 'released' when 'signup' then 'closed' else 'on hold' end as state from {events}) x""",
    "operation_text": """
        select wo_id, sequence_no, case when wo_id % 5 > 0 then 'type ' || cast(resource_id as varchar(10)) end as type_text, case when wo_id % 7 = 0 then ' ' when wo_id % 11 > 0 then 'own' end as own_text from {operation}""",
    "invoice_reference": """
        select o_orderkey as invoice_id, 'P' || cast(o_orderkey as varchar(20)) as packlist_id, 'O' || cast(o_orderkey as varchar(20)) as order_ref, o_totalprice as amount from {orders}""",
    "remittance": """
        select o_orderkey as payment_id, case when o_orderkey % 5 = 1 then o_totalprice + 7 else o_totalprice end as amount,
          case o_orderkey % 7 when 0 then 'P' || cast(o_orderkey as varchar(20)) when 1 then 'O' || cast(o_orderkey as varchar(20)) when 2 then 'P' || cast(o_orderkey as varchar(20)) || ', P' || cast(o_orderkey + 1 as varchar(20))
            when 3 then 'P' || cast(o_orderkey as varchar(20)) || ',X' when 4 then 'X1,X2' when 5 then 'NO PO' else 'Q' || cast(o_orderkey as varchar(20)) end as reference
        from {orders}""",
    "demand_link": """
        select wo_id as order_line_id, wo_id from {work_order} where wo_id % 3 = 0""",
    "shipped_trace": """
        select wo_id as order_line_id, wo_id from {work_order} where wo_id % 3 <> 2
        union all select wo_id as order_line_id, wo_id + 1 as wo_id from {work_order} where wo_id % 9 = 1""",
    "warehouse": """
        select cast(r_regionkey as bigint) as warehouse_id, 'WH ' || r_name as warehouse_name from {region}""",
    "part_stock": """
        select part_id, supplier_id % 5 as warehouse_id, 'BIN-' || cast(line_no as varchar(10)) as location, case when return_flag = 'R' then -quantity when order_id % 11 = 0 then 0.0 else quantity end as quantity from {order_line}""",
    "job_transaction": """
        select order_id * 10 + line_no as transaction_id, order_id as wo_id, case when line_no % 3 > 0 then line_no end as sub_id, case when return_flag = 'A' then 'I' else 'O' end as type, case when part_id % 2 = 0 then 'I' else 'R' end as class, quantity
        from {order_line}""",
    "requirement": """
        select order_id as wo_id, case when line_no % 3 > 0 then line_no end as sub_id, min(part_id) as part_id, sum(quantity) as required_qty from {order_line} where order_id % 4 > 0 group by order_id, case when line_no % 3 > 0 then line_no end""",
    "trans_dist": """
        select order_id * 10 + line_no as id, order_id * 10 + line_no as in_id, case when line_no % 2 = 1 then order_id * 10 + line_no + 1 else order_id * 10 + line_no - 1 end as out_id from {order_line} where order_id % 2 = 0""",
    "component": """
        select o.customer_id as product_id, l.part_id, l.quantity, s.supplier_name, l.amount / l.quantity as unit_cost from {order_line} l join {customer_order} o on o.order_id = l.order_id join {suppliers} s on s.supplier_id = l.supplier_id""",
    "routing_step": """
        select l.order_id * 10 + l.line_no as wo_id, cast(10 * s.k as bigint) as sequence_no, case when (l.order_id + s.k) % 2 = 0 then 'C' else 'R' end as step_status, (l.order_id + s.k) % 25 as resource_id
        from {order_line} l cross join (select 1 as k union all select 2 union all select 3) s""",
    "product_line": """
        select cast(r_regionkey + 1 as bigint) as product_line_id, 'PL ' || r_name as product_line_name, case when r_regionkey % 2 = 0 then 'Aerospace' else 'Energy' end as primary_market, cast(100 + 10 * r_regionkey as double) as unit_price from {region}""",
    "product_defect": """
        select n.ncm_id as defect_id, coalesce(l.product_line_name, 'PL none') as product_line, n.detection_date as production_date, cast(n.quantity_affected as bigint) as defect_count, cast(n.quantity_affected * 20 as bigint) as total_produced,
          case n.ncm_id % 3 when 0 then 'Critical' when 1 then 'Major' else 'Minor' end as severity
        from {ncm} n left join {product_line} l on l.product_line_id = n.ncm_id % 6 + 1""",
    "part_document": """
        select p_partkey as part_id, 'DOC-' || cast(p_partkey % 13 as varchar(10)) as document_id, p_size > 25 as stocked from {part} where p_partkey % 4 > 0
        union all select p_partkey as part_id, 'DWG-' || cast(p_size as varchar(10)) as document_id, p_size > 25 as stocked from {part} where p_partkey % 3 = 1""",
    "customer_address": """
        select c_custkey as customer_id, 2 as address_no, 'Second ' || c_name as address from {customer} where c_custkey % 3 > 0 union all select c_custkey as customer_id, 1 as address_no, 'First ' || c_name as address from {customer} where c_custkey % 2 = 0""",
    "certification": """
        select cast(n_nationkey as bigint) as resource_id, 'CERT-' || cast(n_regionkey as varchar(10)) as certification, date '2025-01-01' + cast(n_nationkey as int) as expires from {nation} where n_nationkey % 3 > 0
        union all select cast(n_nationkey as bigint) as resource_id, 'CERT-X' as certification, date '2026-01-01' as expires from {nation} where n_nationkey % 4 = 1""",
}


def needed(names: list[str]) -> list[str]:
    """Canonical tables in an order in which each stands behind those it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in CANONICAL and name not in out:
            for x in re.findall(r"\{(\w+)\}", CANONICAL[name]):
                visit(x)
            out.append(name)

    for name in names:
        visit(name)
    return out


def oracle(sql: str) -> str:
    """A SQL text over {tables} as one statement for an engine that has the star tables as views."""
    used = needed(re.findall(r"\{(\w+)\}", sql))
    plain = lambda x: re.sub(r"\{(\w+)\}", r"\1", x)
    clauses = [f"{name} as ({plain(CANONICAL[name]).strip()})" for name in used]
    body = plain(sql).strip()
    if not clauses:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ",\n".join(clauses) + ",\n" + body[len("with recursive") :]
    if body.lower().startswith("with"):
        return "with " + ",\n".join(clauses) + ",\n" + body[len("with") :]
    return "with " + ",\n".join(clauses) + "\n" + body


#: Tables that are read dealt by a key: all rows of an order stand in one task, where they are summed to lines and meet their order.
DEALT = {("order_line", "lineitem"): "l_orderkey"}


class Tables:
    """Lazy access to star and canonical tables: tables["work_order"]. A query that derives several tables from one, or
    reads one more than once, can have it kept."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in CANONICAL:
                used = {x: self[x] for x in re.findall(r"\{(\w+)\}", CANONICAL[name])}
                used = {x: deal(df, DEALT[name, x]) if (name, x) in DEALT else df for x, df in used.items()}
                self._known[name] = self.spark.sql(CANONICAL[name], **used)
            elif name in STAR:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise KeyError(f"unknown table {name!r}")
        return self._known[name]

    def kept(self, *names: str) -> Tables:
        """The same tables, of which the named ones are written once, in this order; those derived from them read what was
        written. Else Spark computes them anew for each use, as each use needs other columns."""
        out = Tables(self.spark, self.sf_dir)
        for name in names:
            out._known[name] = cut(out[name], name)
        return out
