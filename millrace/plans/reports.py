"""Registered smaller reports."""

from millrace.operators import ledger, reports as op, shopfloor
from pyspark.sql import functions as F

from .define import Registry, cents_sql
from .ledger import LINES

plans = Registry()
add = plans.add
promised = lambda t: t["delivery"].withColumn("promised_date", F.date_add("delivery_date", (F.col("delivery_id") % 9 - 5).cast("int")))
add("d14_supplier_performance", lambda t: op.supplier_performance(t["suppliers"], promised(t)), """
  with x as (select s.supplier_id, supplier_name, -(delivery_id % 9 - 5) as late from {suppliers} s left join {delivery} d on d.supplier_id = s.supplier_id)
  select supplier_id, supplier_name, count(late) as total_deliveries, count(*) filter (late <= 0) as on_time_deliveries, round(100 * count(*) filter (late <= 0) / nullif(count(late), 0), 2) as on_time_pct, round(avg(late) filter (late > 0), 2) as avg_days_late from x group by 1, 2""")
add("d15_product_quality", lambda t: op.product_quality(t["order_line"].select("part_id", F.col("quantity").alias("produced"), F.when(F.col("return_flag") == "R", F.col("quantity")).otherwise(0.0).alias("defects"))), """
  select part_id, count(*) as runs, sum(quantity) as produced, sum(if(return_flag = 'R', quantity, 0)) as defects, round(sum(if(return_flag = 'R', quantity, 0)) / nullif(sum(quantity), 0), 4) as defect_rate from {order_line} group by 1""")
add("d08_order_status_list", lambda t: op.order_status_list(t["purchase_order"]), "select status, po_type, count(*) as po_count, cast(sum(cast(total_cost as decimal(18, 2))) as double) as total_value from {purchase_order} group by 1, 2")
add("d17_high_risk_suppliers", lambda t: op.high_risk_suppliers(t["delivery"]), """
  select supplier_id, count(distinct part_id) as products, round(100 * avg(if(ontime_rate >= 1, 1.0, 0.0)), 4) as on_time_pct from {delivery} group by 1 having count(distinct part_id) >= 2 and round(100 * avg(if(ontime_rate >= 1, 1.0, 0.0)), 4) < 80""")
add("d19_supplier_averages", lambda t: op.supplier_averages(t["delivery"]), f"select supplier_id, count(*) as deliveries, {cents_sql('100 * avg(ontime_rate)', 4)} as avg_ontime_pct, {cents_sql('100 * avg(quality_score)', 4)} as avg_quality_pct from {{delivery}} group by 1")
add("d24_delivery_totals", lambda t: op.delivery_totals(t["suppliers"], t["delivery"].where("supplier_id % 4 > 0")), f"""
  select s.supplier_id, count(delivery_id) as delivery_count, {cents_sql('avg(ontime_rate)', 6)} as otd_avg, {cents_sql('avg(quality_score)', 6)} as quality_avg from {{suppliers}} s left join {{delivery}} d on d.supplier_id = s.supplier_id and d.supplier_id % 4 > 0 group by 1""")
add("d27_order_documents", lambda t: op.order_documents(t["po_line"], t["part_document"]), """
  with d as (select part_id, string_agg(distinct document_id, ', ' order by document_id) as documents, bool_or(stocked) as stocked from {part_document} group by 1)
  select line_id, po_id, p.part_id, coalesce(documents, '') as documents, if(stocked is null, 'Unknown', if(stocked, 'Stocked', 'Consumable')) as stock_label from {po_line} p left join d on d.part_id = p.part_id""")
add("c02_order_delivery", lambda t: op.order_delivery(t["delivery"], t["product_line"], "1995-01-01"), f"""
  select cast(delivery_date as varchar) as delivery_date, product_line_name, primary_market, count(*) as total_deliveries, {cents_sql('avg(ontime_rate) * 100', 1)} as avg_ontime_pct, {cents_sql('avg(quality_score) * 100', 1)} as avg_quality_score, sum(actual_quantity) as units_delivered, sum(planned_quantity) as units_planned,
    round(sum(actual_quantity) / nullif(sum(planned_quantity), 0) * 100, 1) as fill_rate_pct, count(*) filter (ontime_rate >= 0.95) as on_time_count, count(*) filter (ontime_rate < 0.80) as late_count
  from {{delivery}} d left join {{product_line}} l on l.product_line_id = d.delivery_id % (select max(product_line_id) from {{product_line}}) + 1 where delivery_date >= date '1995-01-01' group by 1, 2, 3""")
add("c03_quality_exposure", lambda t: op.quality_exposure(t["product_defect"], t["product_line"], "1996-01-01"), f"""
  select d.product_line, primary_market, unit_price, count(*) as defect_events, sum(defect_count) as total_defects, sum(total_produced) as total_produced, round(sum(defect_count) / nullif(sum(total_produced), 0) * 100, 2) as overall_defect_rate_pct,
    coalesce(sum(defect_count) filter (severity = 'Critical'), 0) as critical_defects, coalesce(sum(defect_count) filter (severity = 'Major'), 0) as major_defects, {cents_sql('sum(defect_count) * unit_price * 0.15')} as estimated_rework_cost
  from {{product_defect}} d left join {{product_line}} l on l.product_line_name = d.product_line where production_date >= date '1996-01-01' group by 1, 2, 3""")
add("c16_packing_list", lambda t: op.packing_list(t["customer_order_line"].join(t["customer_order"].select("order_id", "customer_id"), "order_id").where("shipped_qty > 0"), t["customer_address"], t["demand_link"], "Plant 1"), """
  select l.order_line_id, o.customer_id, a.ship_to, d.wo_id, shipped_qty, 'Plant 1' as ship_from from {customer_order_line} l join {customer_order} o on o.order_id = l.order_id
  left join (select customer_id, arg_min(address, address_no) as ship_to from {customer_address} group by 1) a on a.customer_id = o.customer_id left join {demand_link} d on d.order_line_id = l.order_line_id where shipped_qty > 0""")
add("o04_certification_compliance", lambda t: op.certification_compliance(t["shop_resource"], t["certification"]), """
  select r.resource_id, description, certification, cast(expires as varchar) as expires, if(certification is null, 'Missing', 'Held') as compliance from {shop_resource} r left join {certification} c on c.resource_id = r.resource_id where active = 1""")
add("o04_active_operations", lambda t: op.active_operations(t["operation"], t["shop_resource"]), "select wo_id, sequence_no, o.resource_id, description, status, run_hrs - act_run_hrs as hours_left from {operation} o join {shop_resource} r on r.resource_id = o.resource_id and active = 1 where status in ('S', 'Q')")
D = "cast(act_{0}_cost as decimal(18, 2))"
add("o06_cost_detail", lambda t: op.cost_detail(t["work_order"]), "select wo_id, status, " + ", ".join(f"cast({D.format(k)} as double) as {k}_cost" for k in ("lab", "bur", "ser", "mat")) + ", cast(" + " + ".join(D.format(k) for k in ("lab", "bur", "ser", "mat")) + " as double) as total_cost from {work_order}")
WEEK = "(select resource_id, date_trunc('week', sched_start_date) as w, round(sum(setup_hrs + run_hrs), 4) as load_hrs from {operation} where sched_start_date is not null group by 1, 2)"
add("o10_shifts_required", lambda t: op.shifts_required(shopfloor.weekly_load(t["operation"])), f"""
  with p as (select resource_id, max(load_hrs) as peak_load_hrs, cast(ceil(max(load_hrs) / 40) as bigint) as shifts_required from {WEEK} x group by 1) select *, if(shifts_required > 2, 'Add shifts', if(shifts_required < 2, 'Reduce shifts', 'Keep')) as recommendation from p""")
add("o13_capacity_totals", lambda t: op.capacity_totals(t["operation"], t["inventory_transaction"]), """
  select 'capacity_total_load' as measure, 'all' as key, round(cast(sum(setup_hrs + run_hrs) as double), 2) as value from {operation} union all select 'work_center_load', cast(resource_id as varchar), round(sum(setup_hrs + run_hrs), 2) from {operation} group by 2
  union all select 'routing_total_run_hours', 'all', round(sum(run_hrs), 2) from {operation} union all select 'work_order_step_count', cast(wo_id as varchar), count(*) from {operation} group by 2
  union all select 'total_in_qty', 'all', round(sum(quantity), 2) from {inventory_transaction} where type = 'I' union all select 'total_out_qty', 'all', round(sum(quantity), 2) from {inventory_transaction} where type = 'O'
  union all select 'part_in_qty', cast(part_id as varchar), round(sum(quantity), 2) from {inventory_transaction} where type = 'I' group by 2 union all select 'part_out_qty', cast(part_id as varchar), round(sum(quantity), 2) from {inventory_transaction} where type = 'O' group by 2""")
add("l08_tie_out_actuals", lambda t: op.tie_out_actuals(ledger.post(t["gl_events"]), t["job"].withColumn("act_cost", F.when(F.col("job_id") % 10 == 3, F.col("act_cost") + 5).otherwise(F.col("act_cost")))), f"""
  with f as (select job_id, sum(cast(amount as decimal(18, 2))) as v from {LINES} x where ledger = 'FG' group by 1), j as (select job_id, if(job_id % 10 = 3, act_cost + 5, act_cost) as act_cost from {{job}})
  select j.job_id, act_cost, coalesce(cast(v as double), 0) as posted, cast(cast(act_cost as decimal(18, 2)) - coalesce(v, 0) as double) as gap from j left join f on f.job_id = j.job_id where abs(cast(act_cost as decimal(18, 2)) - coalesce(v, 0)) >= 0.01""")
QUERIES, ORACLES = plans.queries, plans.oracles
