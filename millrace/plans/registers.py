"""Registered register and reshaping queries."""

from millrace.operators import planning, registers as rg, statistics
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
add = plans.add
SIGNED = "sum(if(type = 'I', quantity, -quantity))"


def open_lines(t):
    return planning.open_lines(t["customer_order"], t["customer_order_line"]).select("order_line_id", "part_id", "need_by_date", F.col("order_qty").alias("open_qty"))


add("p24_site_balances", lambda t: rg.site_balances(t["inventory_transaction"]), f"select part_id, site_id, {SIGNED} as net_qty, cast(max(trans_date) as varchar) as last_date from {{inventory_transaction}} group by 1, 2 having {SIGNED} <> 0")
add("p22_due_against_stock", lambda t: rg.due_against_stock(t["erp_part"], open_lines(t)), """
  with x as (select l.*, on_hand_qty, sum(order_qty) over w as r, row_number() over w as k from {customer_order_line} l join {customer_order} o on o.order_id = l.order_id and status = 'Open' join {erp_part} p on p.part_id = l.part_id
    window w as (partition by l.part_id order by need_by_date, order_line_id rows unbounded preceding))
  select order_line_id, part_id, order_qty as open_qty, round(r, 2) as running_due, r <= on_hand_qty as covered, k = 1 as first_in_part from x""")
add("p27_trace_rollup", lambda t: rg.trace_rollup(t["inventory_transaction"]), "select part_id, type, string_agg(transaction_id, ',' order by transaction_id) as transaction_ids, count(*) as n, round(sum(quantity), 2) as quantity from {inventory_transaction} group by 1, 2")
add("p30_attributes_to_columns", lambda t: rg.attributes_to_columns(t["events"].select(F.col("user_id").alias("doc"), F.col("event_type").alias("name"), F.round("value", 2).alias("value")), ["click", "purchase", "view"]), """
  select user_id as doc, max(round(value, 2)) filter (event_type = 'click') as click, max(round(value, 2)) filter (event_type = 'purchase') as purchase, max(round(value, 2)) filter (event_type = 'view') as view from events group by 1""")
add("o14_latest_ticket", lambda t: rg.latest_per_key(t["events"].select("user_id", "event_id", F.col("ts").cast("string").alias("ts")), "user_id", ["ts", "event_id"]).drop("ts"), "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
add("o15_split_text", lambda t: rg.split_text(t["benchmark"], "text").drop("text"), r"select item_id, trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')) as first_line, trim(regexp_replace(string_split(text, chr(10))[2], '\s+', ' ', 'g')) as second_line from benchmark")
add("o16_work_order_number", lambda t: rg.work_order_number(t["order_line"].select(F.col("order_id").alias("base_id"), (F.col("line_no") % 3).alias("sub_id"), F.col("line_no").alias("lot_id"), (F.col("part_id") % 2).alias("split_id"))), """
  select order_id as base_id, line_no % 3 as sub_id, line_no as lot_id, part_id % 2 as split_id, order_id || if(line_no % 3 > 0, '-' || (line_no % 3), '') || '/' || line_no || if(part_id % 2 > 0, '.1', '') as wo_number from {order_line}""")
add("q01_daily_defects", lambda t: rg.daily_defects(statistics.series_of(t["lineitem"]), 30), """
  with d as (select cast(l_shipdate as date) as day, count(*) as produced, count(*) filter (l_returnflag = 'R') as defects from lineitem group by 1)
  select cast(day as varchar) as day, produced, defects, round(100 * defects / produced, 4) as defect_rate from d where day > (select max(day) - 30 from d)""")
add("i02_column_profile", lambda t: rg.column_profile(t["customer"]), " union all ".join(
    f"select '{c}' as column_name, count({c}) as non_null, count(distinct {c}) as distinct_values, min(cast({c} as varchar)) as least, max(cast({c} as varchar)) as greatest from customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
add("i11_surrogate_keys", lambda t: rg.surrogate_keys(t["part"], "p_name", t["part"].where("p_partkey <= 40").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))), """
  with k as (select p_name as name, min(p_partkey) as id from part where p_partkey <= 40 group by 1), f as (select distinct p_name as name from part where p_name not in (select name from k))
  select id, name from k union all select (select max(id) from k) + row_number() over (order by name), name from f""")
add("v09_domains_and_dates", lambda t: t["customer"].select("c_custkey", rg.email_domain(F.concat(F.lit(" U"), "c_custkey", F.lit("@Mail.EU.Example.com"))).alias("domain"), rg.parse_date(F.when(F.col("c_custkey") % 3 == 0, "2024-02-29").when(F.col("c_custkey") % 3 == 1, "29.02.2024").otherwise("never")).cast("string").alias("day")), "select c_custkey, 'example.com' as domain, if(c_custkey % 3 < 2, '2024-02-29', null) as day from customer")
add("n08_common_tables", lambda t: rg.common_tables(t["lineitem"].select((F.col("l_partkey") % 300).alias("table_name"), (F.col("l_suppkey") % 20).alias("file"))), """
  with u as (select distinct l_partkey % 300 as t, l_suppkey % 20 as f from lineitem) select a.f as file_a, b.f as file_b, count(*) as tables from u a join u b on a.t = b.t and a.f < b.f group by 1, 2""")
add("d22_link_vouchers", lambda t: rg.link_vouchers(t["payable_line"].withColumn("receipt_line_id", F.when(F.col("payable_line_id") % 300 > 0, F.col("receipt_line_id"))), t["receiving_line"]), "select payable_line_id, po_line_id, receipt_line_id from {payable_line}")
QUERIES, ORACLES = plans.queries, plans.oracles
