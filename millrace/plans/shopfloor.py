"""Registered shop-floor queries."""

from millrace.operators import shopfloor as op

from .define import Registry, cents_sql

plans = Registry()
add = plans.add
S = "{shop_resource} r left join {operation} o on o.resource_id = r.resource_id where active = 1"
COST = "act_lab_cost + act_bur_cost"

add("o01_oee_operational", lambda t: op.oee_operational(t["shop_resource"], t["operation"]), f"""
  select r.resource_id, description, resource_type, count(wo_id) as operation_count, {cents_sql('sum(run_hrs)')} as scheduled_run_hrs, {cents_sql('sum(act_run_hrs)')} as actual_run_hrs,
    if(sum(run_hrs) > 0, {cents_sql('sum(act_run_hrs) / sum(run_hrs)', 4)}, null) as performance_ratio from {S} group by 1, 2, 3""")
add("o02_oee_strategic", lambda t: op.oee_strategic(t["shop_resource"], t["operation"]), f"""
  select resource_type, count(distinct r.resource_id) as resource_count, {cents_sql('sum(run_hrs)')} as total_scheduled_hrs, {cents_sql(f'sum({COST})')} as total_actual_cost,
    if(sum(act_run_hrs) > 0, {cents_sql(f'sum({COST}) / sum(act_run_hrs)')}, null) as cost_per_actual_hr, if(sum(run_hrs) > 0, {cents_sql('sum(act_run_hrs) / sum(run_hrs)', 4)}, null) as utilization_ratio from {S} group by 1""")
add("o03_open_operations", lambda t: op.open_operations(t["shop_resource"], t["operation"]), f"""
  select r.resource_id, description, resource_type, count(*) filter (status <> 'C') as open_operations, {cents_sql("coalesce(sum(run_hrs - act_run_hrs) filter (status <> 'C'), 0)")} as remaining_run_hrs, cast(max(close_date) as varchar) as last_close_date from {S} group by 1, 2, 3""")
add("o05_delivery_state", lambda t: op.delivery_state(t["work_order"]), """
  with n as (select max(open_date) as d from {work_order})
  select wo_id, part_id, status, if(close_date is not null, if(close_date > required_date, 'Late', 'On Time'), if(n.d > required_date, 'Overdue', if(n.d > required_date - 7, 'At Risk', 'On Schedule'))) as customer_delivery_status from {work_order}, n""")
add("o06_status_rollup", lambda t: op.status_rollup(t["work_order"]), """
  select status, count(*) as order_count, sum(quantity) as total_qty, cast(sum(cast(act_lab_cost as decimal(18, 2)) + cast(act_bur_cost as decimal(18, 2)) + cast(act_ser_cost as decimal(18, 2)) + cast(act_mat_cost as decimal(18, 2))) as double) as total_actual_cost,
    cast(sum(outside_service) as bigint) as orders_with_outside_service from {work_order} group by 1""")
LOAD = "(select wo_id, resource_id, cast(cast(date_trunc('week', sched_start_date) as date) as varchar) as week_start, setup_hrs + run_hrs as load_hrs from {operation} where sched_start_date is not null)"
WEEK = f"(select resource_id, week_start, count(*) as operations, round(sum(load_hrs), 4) as load_hrs from {LOAD} x group by 1, 2)"
add("o07_load_register", lambda t: op.load_register(t["operation"]), f"select * from {LOAD} x")
add("o08_weekly_load", lambda t: op.weekly_load(t["operation"]), f"select *, 80e0 as capacity_hrs, round(100 * load_hrs / 80, 4) as util_pct, if(load_hrs > 80, 'OVER', 'ok') as verdict from {WEEK} x")
add("o09_bottlenecks", lambda t: op.bottlenecks(op.weekly_load(t["operation"], shifts=1, hours=4.0)), f"""
  select resource_id, max(load_hrs) as peak_load_hrs, count(*) filter (load_hrs > 20) as weeks_over, count(*) as weeks,
    if(count(*) filter (load_hrs > 20) = 0, 'ok', if(2 * count(*) filter (load_hrs > 20) >= count(*), 'BOTTLENECK', 'watch')) as verdict, cast(ceil(max(load_hrs) / 40) as bigint) as shifts_required from {WEEK} x group by 1""")
add("o11_routing_traveler", lambda t: op.routing_traveler(t["operation"], t["shop_resource"]), f"""
  select wo_id, sequence_no, o.resource_id, description, status, {cents_sql('run_hrs', 4)} as sched_hrs, {cents_sql('act_run_hrs', 4)} as actual_hrs, {cents_sql('run_hrs * run_cost_per_hr')} as sched_cost from {{operation}} o join {{shop_resource}} r on r.resource_id = o.resource_id""")
add("o12_station_load", lambda t: op.station_load(t["operation"]), f"select resource_id, status, count(*) as operations, {cents_sql('sum(setup_hrs + run_hrs)')} as hours from {{operation}} group by 1, 2")
add("l13_actual_cost_rollup", lambda t: op.actual_cost_rollup(t["operation"], t["shop_resource"]), f"""
  with x as (select o.wo_id, run_hrs * case status when 'C' then 1 when 'S' then 0.5e0 else 0 end as h, run_cost_per_hr as a, bur_per_hr_run as b from {{operation}} o join {{shop_resource}} r on r.resource_id = o.resource_id)
  select wo_id, {cents_sql('sum(h * a)')} as labor, {cents_sql('sum(h * b)')} as burden from x group by 1""")
QUERIES, ORACLES = plans.queries, plans.oracles
