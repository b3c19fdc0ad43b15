"""Registered customer order and receivable queries."""

from millrace.operators import sales as op

from .define import Registry, exact_sum

plans = Registry()
add = plans.add
SUM = "cast(sum(cast({} as decimal(18, 2))) as double)"

add("c01_order_lifecycle", lambda t: op.order_lifecycle(t["customer_order"], t["customer_order_line"]), """
  with l as (select order_id, sum(order_qty) as q, sum(coalesce(shipped_qty, 0)) as s, max(need_by_date) as due from {customer_order_line} group by 1)
  select o.order_id, status, round(100 * s / q, 4) as completion_pct,
    if(status = 'Closed', if(due <= order_date + 400, 'On Time', 'Late'), if(due < (select max(order_date) from {customer_order}), 'Overdue', 'In Progress')) as lifecycle
  from {customer_order} o join l on l.order_id = o.order_id""")
add("c04_customer_profile", lambda t: op.customer_profile(t["customer"], t["nation"]), "select c_custkey as customer_id, c_mktsegment || ' ' || c_name as full_name, n_name || ', ' || if(c_acctbal >= 0, c_mktsegment, null) as address from customer left join nation on n_nationkey = c_nationkey")
add("c05_customer_revenue", lambda t: op.customer_revenue(t["customer_order"], t["customer_order_line"]), "select customer_id, count(distinct o.order_id) as orders, count(distinct part_id) as products, round(sum(order_qty), 2) as units from {customer_order} o join {customer_order_line} l on l.order_id = o.order_id group by 1")
add("c06_customers_by_region", lambda t: op.customers_by_region(t["customer"], t["nation"]), "select n_name, count(distinct c_custkey) as customers, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as segments from customer join nation on n_nationkey = c_nationkey group by 1")
add("c07_revenue_recognition", lambda t: op.revenue_recognition(t["customer_order"]), f"""
  select case status when 'Closed' then 'Recognized' when 'Shipped' then 'Billable — shipped, not closed' else 'Backlog — booked, not recognizable' end as revenue_stage, count(*) as orders, {SUM.format('total_price')} as amount from {{customer_order}} group by 1""")
add("c08_customer_exposure", lambda t: op.customer_exposure(t["customer_order"]), f"""
  select customer_id, {exact_sum('total_price', "status = 'Shipped'")} as billable, {exact_sum('total_price', "status = 'Open'")} as backlog, {exact_sum('total_price', "status = 'Closed'")} as recognized from {{customer_order}} group by 1""")
add("c09_backlog_aging", lambda t: op.backlog_aging(t["customer_order"]), f"""
  with x as (select *, date_diff('day', order_date, (select max(order_date) from {{customer_order}})) as d from {{customer_order}} where status = 'Open')
  select case when d > 180 then 'Over 180 days' when d > 90 then '91-180' when d > 30 then '31-90' else '0-30' end as age_bucket, count(*) as orders, {SUM.format('total_price')} as amount from x group by 1""")
add("c10_ar_aging", lambda t: op.ar_aging(t["receivable"]), f"""
  with x as (select *, date_diff('day', due_date, (select max(payment_date) from {{receivable}} where status = 'Paid')) as d from {{receivable}} where status <> 'Paid')
  select case when d is null or d > 60 then '>60' when d > 30 then '31-60' when d > 0 then '1-30' else 'Current' end as bucket, count(*) as invoices, {SUM.format('amount_dollars')} as amount from x group by 1""")
add("c11_cash_receipts", lambda t: op.cash_receipts(t["receivable"], t["receivable_payment"]), """
  with x as (select p.*, amount_dollars, cast(sum(cast(amount as decimal(18, 2))) over (partition by p.invoice_id order by p.payment_date) as double) as s from {receivable_payment} p join {receivable} r on r.invoice_id = p.invoice_id)
  select invoice_id, installment_no, cast(payment_date as varchar) as payment_date, amount, s as cumulative_paid, round(amount_dollars - s, 2) as remaining from x""")
add("c12_monthly_orders", lambda t: op.monthly_orders(t["customer_order"]), """
  with m as (select strftime(unnest(generate_series(date_trunc('month', max(order_date)) - interval 11 month, date_trunc('month', max(order_date)), interval 1 month)), '%Y-%m') as month from {customer_order})
  select m.month, count(o.order_id) as placed, count(*) filter (status = 'Closed') as completed from m left join {customer_order} o on strftime(order_date, '%Y-%m') = m.month group by 1""")
add("c13_installments", lambda t: op.installments(t["receivable"]), """
  with x as (select invoice_id, cast(round(amount_dollars * 100) as bigint) as c from {receivable})
  select invoice_id, cast(k as int) as installment_no, if(k < 3, c // 3, c - 2 * (c // 3)) as cents from x, (select unnest([1, 2, 3]) as k)""")
add("c14_routing_pivot", lambda t: op.routing_pivot(t["order_line"]), "select order_id, count(*) filter (return_flag = 'A') as A, count(*) filter (return_flag = 'N') as N, count(*) filter (return_flag = 'R') as R from {order_line} group by 1")
add("c15_date_history", lambda t: op.date_history(t["customer_order_line"]), "select order_id, string_agg(distinct cast(need_by_date as varchar), '; ' order by cast(need_by_date as varchar)) as date_history, cast(max(need_by_date) as varchar) as latest_date from {customer_order_line} group by 1")
add("c17_open_demand", lambda t: op.open_demand(t["customer_order"], t["customer_order_line"]), "select part_id, round(sum(order_qty), 2) as open_qty, round(sum(order_qty * unit_price), 2) as open_value from {customer_order_line} l join {customer_order} o on o.order_id = l.order_id and status = 'Open' group by 1")
QUERIES, ORACLES = plans.queries, plans.oracles
