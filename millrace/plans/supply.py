"""Registered demand and supply queries."""

from millrace.operators import supply as op
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
add = plans.add
add("p19_declared_pegs", lambda t: op.declared_pegs(t["customer_order_line"], t["demand_link"], t["shipped_trace"]), """
  select distinct l.order_line_id, l.part_id, coalesce(d.wo_id, s.wo_id) as wo_id, if(coalesce(d.wo_id, s.wo_id) is null, 'N', 'Y') as allocated
  from {customer_order_line} l left join {demand_link} d on d.order_line_id = l.order_line_id left join {shipped_trace} s on s.order_line_id = l.order_line_id""")
# each choice depends on those before it: a walk over a part's work orders, which carries the lines that are used
add("p20_best_match_pegs", lambda t: op.best_match_pegs(t["work_order"], t["customer_order_line"], t["customer_order"]), """
  with recursive l as (
    select l.part_id, order_line_id as id, coalesce(order_qty, 0) as q, o.status in ('Closed', 'Shipped') as done, cast(coalesce(need_by_date, order_date) as date) as due
    from {customer_order_line} l join {customer_order} o on o.order_id = l.order_id),
  ls as (select part_id, list(struct_pack(id := id, q := q, done := done, due := due)) as ls from l group by 1),
  w as (select part_id, wo_id, status = 'closed' as closed, coalesce(quantity, 0) as q, cast(required_date as date) as due, row_number() over (partition by part_id order by wo_id) as k from {work_order}),
  walk as (
    select part_id, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as wo_id, cast(null as bigint) as best from ls
    union all
    select part_id, k, list_append(used, best), wo_id, best from (
      select x.part_id, w.k, x.used, w.wo_id,
        list_min(list_transform(ls.ls, lambda y: struct_pack(a := list_contains(x.used, y.id), b := y.done <> w.closed, c := abs(y.q - w.q), d := coalesce(abs(date_diff('day', w.due, y.due)), 9999), e := y.id))).e as best
      from walk x join w on w.part_id = x.part_id and w.k = x.k + 1 join ls on ls.part_id = x.part_id))
  select wo_id, best as order_line_id, part_id from walk where wo_id is not null""")
add("p25_part_locations", lambda t: op.part_locations(t["part_stock"], t["warehouse"], warehouse_id=2), "select part_id, warehouse_id, warehouse_name, location, quantity from {part_stock} join {warehouse} using (warehouse_id) where quantity <> 0 and warehouse_id = 2")
add("p28_returned_material", lambda t: op.returned_material(t["job_transaction"], t["requirement"], t["trans_dist"]), """
  with r as (select * from {job_transaction} where type = 'I' and class = 'I'), p as (select distinct transaction_id, d.id, if(in_id = transaction_id, out_id, in_id) as paired_id from r join {trans_dist} d on in_id = transaction_id or out_id = transaction_id)
  select r.transaction_id, r.wo_id, r.sub_id, quantity, required_qty, paired_id from r left join {requirement} q on q.wo_id = r.wo_id and q.sub_id is not distinct from r.sub_id left join p on p.transaction_id = r.transaction_id""")
add("r07_either_key_join", lambda t: op.either_key_join(t["part"].select(F.col("p_partkey").alias("id")), t["order_line"].select((F.col("order_id") * 10 + F.col("line_no")).alias("id"), "part_id", "supplier_id"), "id", ["part_id", "supplier_id"]), """
  select p_partkey as id, order_id * 10 + line_no as right_id, part_id, supplier_id from part join {order_line} on part_id = p_partkey or supplier_id = p_partkey""")
add("p29_bom_complexity", lambda t: op.bom_complexity(t["component"]), """
  select product_id, count(distinct part_id) as parts, sum(quantity) as total_quantity, count(distinct supplier_name) as n_suppliers, round(avg(unit_cost), 4) as avg_component_cost, string_agg(distinct supplier_name, ', ' order by supplier_name) as suppliers from {component} group by 1""")
add("p29_products_without_parts", lambda t: op.without_rows(t["customer"].select(F.col("c_custkey").alias("product_id")), "product_id", t["component"]), "select c_custkey as product_id from customer where c_custkey not in (select product_id from {component})")
add("p31_material_locations", lambda t: op.material_locations(t["requirement"], t["part_stock"]), """
  with s as (select part_id, warehouse_id, location, sum(quantity) as on_hand from {part_stock} group by 1, 2, 3 having sum(quantity) > 0) select wo_id, r.part_id, required_qty, warehouse_id, location, on_hand from {requirement} r join s on s.part_id = r.part_id""")
add("p32_transaction_profile", lambda t: op.transaction_profile(t["inventory_transaction"]), "select type, class, count(*) as n, cast(min(trans_date) as varchar) as first_date, cast(max(trans_date) as varchar) as last_date from {inventory_transaction} group by 1, 2")
add("p33_in_list", lambda t: op.in_list(t["erp_part"], "part_class", "PROMO, STANDARD ,ECONOMY").select("part_id", "part_class"), "select part_id, part_class from {erp_part} where part_class in ('PROMO', 'STANDARD', 'ECONOMY')")
add("p34_part_history", lambda t: op.part_history(t["inventory_transaction"], t["erp_part"]), """
  select transaction_id, x.part_id, part_description, unit_of_measure, type, class, quantity, cast(trans_date as varchar) as trans_date from {inventory_transaction} x join {erp_part} p on p.part_id = x.part_id""")
add("d26_service_next_operation", lambda t: op.next_rows(
    t["receiving_line"].select("receipt_line_id", F.col("po_line_id").alias("wo_id"), (F.col("receipt_line_id") % 3 * 10).alias("demand_seq")), t["routing_step"], "wo_id", "demand_seq", "sequence_no"
).select("receipt_line_id", "wo_id", "sequence_no", "step_status", "resource_id"), """
  select receipt_line_id, wo_id, sequence_no, step_status, resource_id from {receiving_line} join {routing_step} s on s.wo_id = po_line_id and sequence_no > receipt_line_id % 3 * 10 qualify row_number() over (partition by receipt_line_id order by sequence_no) = 1""")  # fmt: skip
QUERIES, ORACLES = plans.queries, plans.oracles
