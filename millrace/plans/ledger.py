"""Registered ledger queries."""

from millrace.operators import ledger as op
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
add = plans.add
LINES = """(
  select event_id, job_id, e.event_type, event_date, source_table, source_id, ledger, round(amount * sign, 2) as amount
  from (select * from {gl_events} where amount > 0 and event_date is not null) e
  join (values ('RM_ISSUE', 'RM', -1), ('RM_ISSUE', 'WIP', 1), ('LABOR', 'WIP', 1), ('BURDEN', 'WIP', 1), ('FG_COMPLETION', 'WIP', -1), ('FG_COMPLETION', 'FG', 1), ('CUSTOMER_SHIPMENT', 'FG', -1)) p(event_type, ledger, sign) on p.event_type = e.event_type)"""
SUM = "cast(sum(cast({} as decimal(18, 2))) as double)"
COSTS = "event_type in ('RM_ISSUE', 'LABOR', 'BURDEN')"


def lines(t):
    return op.post(t["gl_events"])


add("l01_post_ledger", lambda t: lines(t).withColumn("event_date", F.col("event_date").cast("string")), "select event_id, job_id, event_type, cast(event_date as varchar) as event_date, source_table, source_id, ledger, amount from " + LINES)
add("l02_post_again", lambda t: op.post(t["gl_events"].union(t["gl_events"]), t["gl_events"].where("event_id % 2 = 0")).withColumn("event_date", F.col("event_date").cast("string")), "select event_id, job_id, event_type, cast(event_date as varchar) as event_date, source_table, source_id, ledger, amount from " + LINES + " x where event_id % 2 = 1")
add("l03_bucket_balances", lambda t: op.bucket_balances(lines(t)), f"""
  select cast(case ledger when 'RM' then 1 when 'WIP' then 2 else 3 end as int) as bucket_order, case ledger when 'RM' then 'Raw Materials' when 'WIP' then 'Work in Process' else 'Finished Goods' end as inventory_bucket,
    count(*) as posting_count, {SUM.format('amount')} as balance from {LINES} x group by ledger""")
add("l04_job_cost_summary", lambda t: op.job_cost_summary(t["gl_events"]), f"select job_id, event_type as cost_element, count(*) as posting_count, {SUM.format('amount')} as total_cost from {{gl_events}} where {COSTS} group by 1, 2")
add("l05_event_trace", lambda t: op.event_trace(t["gl_events"], 7), "select event_id, job_id, event_type, amount, cast(event_date as varchar) as event_date, source_table, source_id from {gl_events} where job_id = 7")
VALUE = "select job_id, count(*) as postings, {} as value, cast(min(event_date) as varchar) as first_date, cast(max(event_date) as varchar) as last_date from " + LINES.replace("{gl_events}", "{{gl_events}}") + " x where {} group by 1"
add("l06_material_issued", lambda t: op.issued_or_produced(lines(t), "RM_ISSUE", "RM"), VALUE.format(SUM.format("-amount"), "event_type = 'RM_ISSUE' and ledger = 'RM'"))
add("l07_goods_produced", lambda t: op.issued_or_produced(lines(t), "FG_COMPLETION", "FG"), VALUE.format(SUM.format("amount"), "event_type = 'FG_COMPLETION' and ledger = 'FG'"))
add("l08_tie_out", lambda t: op.tie_out(t["gl_events"], lines(t).where("job_id % 10 <> 3 or event_type <> 'LABOR'")), f"""
  with c as (select job_id, sum(cast(amount as decimal(18, 2))) as cost from {{gl_events}} where {COSTS} group by 1),
  i as (select job_id, sum(cast(amount as decimal(18, 2))) as inflow from {LINES} x where ledger = 'WIP' and amount > 0 and (job_id % 10 <> 3 or event_type <> 'LABOR') group by 1)
  select coalesce(c.job_id, i.job_id) as job_id, cast(cost as double) as cost, cast(inflow as double) as inflow, cast(coalesce(cost, 0) - coalesce(inflow, 0) as double) as gap
  from c full join i on i.job_id = c.job_id where abs(coalesce(cost, 0) - coalesce(inflow, 0)) >= 0.01""")
add("l09_month_end", lambda t: op.month_end(lines(t)), f"""
  with x as (select strftime(event_date, '%Y-%m') as month, sum(if(ledger = 'WIP', cast(-amount as decimal(18, 2)), 0)) as a, sum(if(ledger = 'FG', cast(amount as decimal(18, 2)), 0)) as b from {LINES} x where event_type = 'FG_COMPLETION' group by 1)
  select month, 'completion' as check_name, cast(a as double) as lhs, cast(b as double) as rhs, a = b as ok from x""")
add("l10_lifecycle_trace", lambda t: op.lifecycle_trace(t["gl_events"]), f"""
  select job_id, cast(1 as int) as stage_order, 'created' as stage, cast(min(event_date) as varchar) as stage_date, null as event_id from {{gl_events}} group by 1
  union all select job_id, if({COSTS}, 2, 3), if({COSTS}, 'cost_event', 'completed'), cast(event_date as varchar), event_id from {{gl_events}} where {COSTS} or event_type = 'FG_COMPLETION'""")
add("l12_resolve_job", lambda t: op.resolve_job(t["orders"].select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("job "), F.col("o_orderkey") * 10 + 1)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("WO-000"), F.col("o_orderkey") * 10 + 1)).otherwise(F.concat(F.lit("x"), F.col("o_orderkey"), F.lit("y"))).alias("reference")), t["work_order"]), """
  with r as (select case o_orderkey % 3 when 0 then 'job ' || (o_orderkey * 10 + 1) when 1 then 'WO-000' || (o_orderkey * 10 + 1) else 'x' || o_orderkey || 'y' end as reference, if(o_orderkey % 3 < 2, o_orderkey * 10 + 1, null) as k from orders)
  select reference, wo_id, if(wo_id is null, 'none', 'found') as result from r left join {work_order} w on w.wo_id = r.k""")
add("l16_ledger_totals", lambda t: op.ledger_totals(lines(t)), f"select ledger, event_type, count(*) as lines, {SUM.format('amount')} as total from {LINES} x group by 1, 2")
QUERIES, ORACLES = plans.queries, plans.oracles
