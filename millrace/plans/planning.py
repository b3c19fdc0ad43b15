"""Registered planning queries."""

from millrace.operators import planning as op
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
START = "(select cast(date_trunc('month', coalesce(max(close_date), date '2026-06-12')) as date) as plan_start from {work_order})"
OPEN = "{customer_order_line} l join {customer_order} o on o.order_id = l.order_id and o.status = 'Open'"
HISTORY = "(select l.part_id, round(avg(l.quantity), 2) as avg_q, sum(l.quantity) as all_q, count(*) as n from {po_line} l join {purchase_order} o on o.po_id = l.po_id where o.status <> 'Cancelled' group by 1)"
RECEIPTS = """(select part_id, required_date as day, quantity as q from {work_order} where status in ('unreleased', 'firmed', 'released')
  union all select l.part_id, o.required_date, l.quantity from {po_line} l join {purchase_order} o on o.po_id = l.po_id where o.status in ('Open', 'Partial'))"""


def bucket(day: str, past: int) -> str:
    return f"case when {day} < plan_start then {past} else date_diff('month', plan_start, {day}) + {past + 1} end"


plans.add("p01_reorder_status", lambda t: op.reorder_status(t["erp_part"]), """
  select part_id, part_description, part_class, unit_of_measure, on_hand_qty, reorder_point, lead_time_days, round(on_hand_qty - reorder_point, 2) as qty_vs_reorder,
    if(on_hand_qty <= 0, 'STOCKOUT', if(on_hand_qty <= reorder_point, 'REORDER', 'OK')) as replenishment_status from {erp_part} where active = 1""")
plans.add("p02_on_hand_value", lambda t: op.on_hand_value(t["erp_part"]), """
  select part_class, count(*) as part_count, round(sum(on_hand_qty), 2) as total_on_hand, round(sum(on_hand_qty * unit_cost), 2) as inventory_value,
    count(*) filter (on_hand_qty <= 0) as stockout_count, count(*) filter (on_hand_qty > 0 and on_hand_qty <= reorder_point) as at_reorder_count,
    count(*) filter (on_hand_qty > reorder_point) as adequate_count from {erp_part} where active = 1 group by part_class""")
plans.add("p03_lead_time_profile", lambda t: op.lead_time_profile(t["erp_part"], 40), """
  select part_class, count(*) as part_count, round(avg(lead_time_days), 1) as avg_lead_time_days, min(lead_time_days) as min_lead_time_days, max(lead_time_days) as max_lead_time_days,
    count(*) filter (lead_time_days > 40) as long_lead_count from {erp_part} where active = 1 and lead_time_days > 0 group by 1""")
plans.add("p04_time_phased_atp", lambda t: op.time_phased_atp(t["erp_part"], t["customer_order"], t["customer_order_line"], t["work_order"], t["po_line"], t["purchase_order"]), f"""
  with st as {START},
  dem as (select part_id, {bucket('need_by_date', -1)} as b, sum(order_qty) as q from {OPEN} cross join st where need_by_date is not null group by 1, 2),
  rec as (select part_id, {bucket('day', -1)} as b, sum(q) as q from {RECEIPTS} r cross join st where day is not null group by 1, 2),
  grid as (select p.*, x.b from {{erp_part}} p cross join (select unnest(range(-1, 6)) as b) x where active = 1),
  bal as (
    select grid.part_id, part_description, part_class, unit_of_measure, on_hand_qty, grid.b, coalesce(dem.q, 0) as g, coalesce(rec.q, 0) as s,
      on_hand_qty + sum(coalesce(rec.q, 0) - coalesce(dem.q, 0)) over (partition by grid.part_id order by grid.b) as pab
    from grid left join dem on dem.part_id = grid.part_id and dem.b = grid.b left join rec on rec.part_id = grid.part_id and rec.b = grid.b)
  select part_id, part_description, part_class, unit_of_measure, cast(b as int) as bucket_index, if(b < 0, 'Past Due', 'M' || b) as bucket, on_hand_qty, g as gross_requirements, s as scheduled_receipts,
    round(pab, 2) as atp_pab, if(pab >= 0, 'AVAILABLE', 'SHORT') as atp_status from bal""")
plans.add("p05_allocated", lambda t: op.allocated(t["erp_part"], t["customer_order"], t["customer_order_line"]), f"""
  select p.part_id, part_description, part_class, unit_of_measure, on_hand_qty, round(sum(order_qty), 2) as allocated_qty, count(distinct l.order_id) as open_order_count, cast(min(need_by_date) as varchar) as earliest_need_by
  from {OPEN} join {{erp_part}} p on p.part_id = l.part_id where active = 1 group by all""")
HORIZON = f"""
  with st as {START}, span as (select plan_start, plan_start + interval 6 month as stop, cast(date_diff('day', plan_start, plan_start + interval 6 month) as double) as days from st),
  dem as (select part_id, sum(order_qty) as q, count(*) as n from {OPEN} cross join span where need_by_date >= plan_start and need_by_date < stop group by 1),
  x as (select p.*, coalesce(q, 0) as q, coalesce(n, 0) as n, days, coalesce(q, 0) / days as daily from {{erp_part}} p cross join span left join dem on dem.part_id = p.part_id where active = 1)"""
plans.add("p06_safety_stock", lambda t: op.safety_stock_proxy(t["erp_part"], t["customer_order"], t["customer_order_line"], t["work_order"]), HORIZON + """
  select part_id, part_class, reorder_point, lead_time_days, on_hand_qty, q as total_open_demand, n as open_order_count, days as horizon_days, round(daily, 4) as avg_daily_demand,
    round(daily * lead_time_days, 2) as lt_demand_proxy, round(reorder_point - daily * lead_time_days, 2) as safety_stock_proxy,
    case sign(reorder_point - daily * lead_time_days) when -1 then 'ROP_UNDERSTATED' when 0 then 'ZERO_BUFFER' else 'ADEQUATE_BUFFER' end as rop_health from x""")
plans.add("p07_lead_time_demand", lambda t: op.lead_time_demand(t["erp_part"], t["customer_order"], t["customer_order_line"], t["work_order"]), HORIZON + """
  select part_id, part_class, lead_time_days, reorder_point, q as total_open_demand, n as open_line_count, days as horizon_days, round(daily, 4) as avg_daily_demand,
    round(daily * lead_time_days, 2) as lead_time_demand, if(round(daily * lead_time_days, 2) > reorder_point, 'ROP_BELOW_LT_DEMAND', 'ROP_COVERS_LT_DEMAND') as coverage_status from x""")
plans.add("p08_minimum_stock", lambda t: op.minimum_stock(t["erp_part"]), """
  select part_id, part_description, part_class, unit_of_measure, reorder_point as minimum_stock_qty, on_hand_qty, lead_time_days, round(on_hand_qty - reorder_point, 2) as buffer_above_min,
    if(on_hand_qty <= 0, 'ZERO_STOCK', case sign(on_hand_qty - reorder_point) when -1 then 'BELOW_MINIMUM' when 0 then 'AT_MINIMUM' else 'ABOVE_MINIMUM' end) as min_stock_status
  from {erp_part} where active = 1""")
plans.add("p09_maximum_stock", lambda t: op.maximum_stock(t["erp_part"], t["po_line"], t["purchase_order"]), f"""
  with x as (select p.*, coalesce(avg_q, 0) as a, coalesce(n, 0) as n, round(reorder_point + coalesce(avg_q, 0), 2) as most from {{erp_part}} p left join {HISTORY} h on h.part_id = p.part_id where active = 1)
  select part_id, part_description, part_class, unit_of_measure, reorder_point as minimum_stock_qty, a as avg_replenishment_qty, n as po_line_count, most as maximum_stock_qty, on_hand_qty,
    if(on_hand_qty > most, 'OVERSTOCKED', if(on_hand_qty < reorder_point, 'BELOW_MINIMUM', 'IN_RANGE')) as minmax_status from x""")
plans.add("p10_eoq_proxy", lambda t: op.eoq_proxy(t["erp_part"], t["po_line"], t["purchase_order"]), f"""
  select p.part_id, part_description, part_class, unit_of_measure, unit_cost, coalesce(avg_q, reorder_point) as eoq_proxy, coalesce(avg_q, 0) as avg_historical_po_qty, coalesce(all_q, 0) as total_historical_po_qty,
    coalesce(n, 0) as po_line_count, cast(round(cast(coalesce(avg_q, reorder_point) * unit_cost as decimal(28,8)), 2) as double) as eoq_order_value, case coalesce(n, 0) when 0 then 'FALLBACK_TO_ROP' when 1 then 'SINGLE_PO_OBSERVATION' else 'MULTI_PO_AVERAGE' end as eoq_confidence
  from {{erp_part}} p left join {HISTORY} h on h.part_id = p.part_id where active = 1""")
plans.add("p11_simple_atp", lambda t: op.simple_atp(t["erp_part"], t["customer_order"], t["customer_order_line"]), f"""
  select p.part_id, part_description, on_hand_qty, d as open_demand_qty, round(on_hand_qty - d, 2) as available_to_promise, if(on_hand_qty < d, 'SHORTAGE', 'covered') as shortage_flag
  from {{erp_part}} p join (select part_id, sum(order_qty) as d from {OPEN} group by 1) x on x.part_id = p.part_id""")
plans.add("p12_running_demand", lambda t: op.running_demand(t["customer_order"], t["customer_order_line"]), f"""
  select part_id, l.order_id, line_no, cast(need_by_date as varchar) as need_by_date, order_qty,
    round(sum(order_qty) over (partition by part_id order by need_by_date, l.order_id, line_no rows unbounded preceding), 2) as running_demand from {OPEN}""")
plans.add("p13_demand_register", lambda t: op.demand_register(t["customer_order"], t["customer_order_line"], t["erp_part"]), """
  select l.order_id, line_no, customer_id, status, l.part_id, part_description, order_qty, cast(round(cast(unit_price as decimal(28,8)), 4) as double) as unit_price, cast(round(cast(order_qty * unit_price as decimal(28,8)), 2) as double) as line_value
  from {customer_order_line} l join {customer_order} o on o.order_id = l.order_id join {erp_part} p on p.part_id = l.part_id""")


def inputs(t):
    return op.netting_inputs(t["erp_part"], t["customer_order"], t["customer_order_line"], op.forecast_of(t["customer_order_line"]), t["work_order"], t["po_line"], t["purchase_order"])


def parts(t):
    return op.planning_parts(t["erp_part"], t["customer_order"], t["customer_order_line"], op.forecast_of(t["customer_order_line"]), t["work_order"])


FORECAST = "(select part_id, cast(date_trunc('month', need_by_date) + interval 12 month as date) as d, order_qty * 1.1e0 as f from {customer_order_line})"
#: Parts with demand in the horizon: lines of open orders and forecasts dated from its start to before its end.
PARTS = f"""
  with st as (select plan_start as low, plan_start + interval 9 month as high from {START}),
  co as (select part_id, count(*) as n, sum(greatest(order_qty - coalesce(shipped_qty, 0), 0)) as q from {OPEN} cross join st where need_by_date >= low and need_by_date < high group by 1),
  fc as (select part_id, sum(f) as q from {FORECAST} cross join st where d >= low and d < high and f > 0 group by 1),
  parts as (
    select p.part_id, part_class, lead_time_days, on_hand_qty, coalesce(n, 0) as demand_lines, round(coalesce(co.q, 0) + coalesce(fc.q, 0), 4) as demand_qty
    from {{erp_part}} p left join co on co.part_id = p.part_id left join fc on fc.part_id = p.part_id where co.part_id is not null or fc.part_id is not null)"""
INPUTS = f"""
  with recursive st as {START},
  co as (select part_id, {bucket('need_by_date', 0)} as b, sum(greatest(order_qty - coalesce(shipped_qty, 0), 0)) as q from {OPEN} cross join st where need_by_date is not null group by 1, 2),
  fc as (select part_id, {bucket('d', 0)} as b, sum(f) as q from {FORECAST} y cross join st where d is not null group by 1, 2),
  rc as (select part_id, {bucket('day', 0)} as b, sum(q) as q from {RECEIPTS} r cross join st where day is not null group by 1, 2),
  inp as (
    select p.part_id, cast(x.b as bigint) as b, on_hand_qty as h, safety_stock as ss, lead_time_days as lead, coalesce(co.q, 0) as co, coalesce(fc.q, 0) as fc, coalesce(rc.q, 0) as s
    from {{erp_part}} p cross join (select unnest(range(0, 10)) as b) x
    left join co on co.part_id = p.part_id and co.b = x.b left join fc on fc.part_id = p.part_id and fc.b = x.b left join rc on rc.part_id = p.part_id and rc.b = x.b
    where active = 1 and lead_time_days > 0)"""
def grid(t):
    t = t.kept("order_line", "work_order", "po_line")
    return op.netting_grid(inputs(t), op.plan_start(t["work_order"]))


plans.add("p14_netting_grid", grid, INPUTS + """,
  walk as (
    select part_id, b, greatest(co, fc) as g, s, h as before, if(greatest(co, fc) > 0, greatest(h + s - greatest(co, fc), ss), h + s) as pab, lead from inp where b = 0
    union all
    select i.part_id, i.b, greatest(i.co, i.fc), i.s, w.pab, if(greatest(i.co, i.fc) > 0, greatest(w.pab + i.s - greatest(i.co, i.fc), i.ss), w.pab + i.s), i.lead
    from walk w join inp i on i.part_id = w.part_id and i.b = w.b + 1),
  net as (
    select walk.*, round(pab - before - s + g, 6) as n, plan_start, cast(if(b = 0, plan_start, plan_start + to_months(cast(b - 1 as int))) as date) - cast(lead as int) as day from walk cross join st),
  rel as (select part_id, if(b = 0 or day < plan_start, 0, date_diff('month', plan_start, cast(day as date)) + 1) as b, sum(n) as q from net where n > 0 group by 1, 2)
  select net.part_id, cast(net.b as int) as bucket_index, round(g, 4) as gross_requirements, round(s, 4) as scheduled_receipts, round(pab, 4) as projected_balance, round(n, 4) + 0e0 as net_requirement, round(coalesce(rel.q, 0), 4) as planned_release
  from net left join rel on rel.part_id = net.part_id and rel.b = net.b""")
plans.add("p15_planning_problems", lambda t: op.planning_problems(parts(t), op.scheduled_receipts(t["work_order"], t["po_line"], t["purchase_order"]), t["work_order"]), PARTS + f""",
  coming as (select distinct part_id from {RECEIPTS} r cross join st where day >= low and day < high)
  select part_id, if(coalesce(lead_time_days, 0) <= 0, 'missing or non-positive lead_time_days', 'no on-hand inventory and no scheduled receipts in the horizon') as problem
  from parts where coalesce(lead_time_days, 0) <= 0 or (coalesce(on_hand_qty, 0) <= 0 and part_id not in (select part_id from coming))""")
plans.add("p16_forecast_consumption", lambda t: op.forecast_consumption(inputs(t)), INPUTS + """
  select part_id, cast(b as int) as bucket_index, round(co, 4) as customer_demand, round(fc, 4) as forecast, round(greatest(co, fc), 4) as gross_requirements from inp where co > 0 or fc > 0""")
plans.add("p17_planning_parts", parts, PARTS + " select * from parts")
plans.add("p18_open_quantity", lambda t: op.open_quantity(t["customer_order_line"]), "select order_line_id, part_id, order_qty, greatest(order_qty - coalesce(shipped_qty, 0), 0) as open_qty from {customer_order_line}")


def requirements(t):
    return t["work_order"].where("status = 'released'").select(F.col("wo_id").alias("requirement_id"), "part_id", "required_date", F.col("quantity").alias("open_qty"))


plans.add("p21_stock_allocation", lambda t: op.stock_allocation(t["erp_part"], requirements(t)), """
  select wo_id as requirement_id, w.part_id, cast(required_date as varchar) as required_date, quantity as open_qty, round(on_hand_qty - sum(quantity) over (partition by w.part_id order by required_date), 2) as remaining
  from {work_order} w join {erp_part} p on p.part_id = w.part_id where status = 'released'""")
plans.add("p26_transaction_kinds", lambda t: op.classify_transactions(t["inventory_transaction"]), """
  select class, type, case class || type when 'RI' then 'Receive' when 'AO' then 'Adjust Out' when 'AI' then 'Adjust In' when 'IO' then 'Issue' when 'II' then 'Issue Return' end as transaction_kind, count(*) as transactions,
    round(sum(quantity) * case class || type when 'AO' then -1 when 'IO' then -1 else 1 end, 2) as signed_qty, cast(min(trans_date) as varchar) as first_date, cast(max(trans_date) as varchar) as last_date from {inventory_transaction} group by 1, 2""")
plans.add("p23_inventory_reconciliation", lambda t: op.reconcile_inventory(t["erp_part"], t["inventory_transaction"]), """
  select p.part_id, on_hand_qty, n as ledger_net, k as n_transactions, d as last_date, if(n = on_hand_qty, 'Y', 'N') as reconciled, if(n > 0, n, on_hand_qty) as best_on_hand
  from {erp_part} p join (select part_id, sum(if(type = 'I', quantity, -quantity)) as n, count(*) as k, cast(max(trans_date) as varchar) as d from {inventory_transaction} group by 1) x on x.part_id = p.part_id""")
QUERIES, ORACLES = plans.queries, plans.oracles
