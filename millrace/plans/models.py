"""Registered sources, materialized models and semantic queries."""

import uuid

from millrace.functions.lineage import shared_folder
from millrace.operators import cleansing as cl, graph as g, models as op, registers as rg, semantics as se
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
add = plans.add


def place(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def typed(t):
    path = place(t, "csv")
    t["supplier"].select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    return op.typed_scan(t.spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", ["s_suppkey"])


def lines(t):
    path = place(t, "lines")
    t["events"].select(F.concat(F.lit("["), F.upper("event_type"), F.lit("] "), F.col("event_id"))).write.text(path)
    return op.numbered_lines(t.spark, path, r"^\[(ERROR|SIGNUP)\]")


def daily(t):
    path, rows = place(t, "daily"), t["events"].select("event_id", "value", F.to_date("ts").alias("day"))
    op.time_range_model(rows, path, "day", "2024-01-01", "2024-01-31")
    return op.time_range_model(rows.where("event_id % 3 > 0 and day <> date'2024-01-09'").withColumn("value", F.lit(1.0)), path, "day", "2024-01-10", "2024-01-12", 2)


add("i01_typed_scan", typed, "select s_suppkey, s_name, cast(s_nationkey as int) as s_nationkey, s_acctbal from supplier")
add("i03_text_scan", lambda t: lines(t).groupBy(F.regexp_extract("value", r"^\[(\w+)\]", 1).alias("level")).agg(F.count("*").alias("n")), "select upper(event_type) as level, count(*) as n from events where event_type in ('error', 'signup') group by 1")
COLUMNS = " union all ".join(f"select '{c}' as c, cast({c} as varchar) as v from customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
add("i02_typed_profile", lambda t: op.typed_profile(t["customer"]), rf"""
  with x as ({COLUMNS}), d as (select c, v, row_number() over (partition by c order by v) as k from (select distinct c, v from x where v is not null)),
  s as (select c, if(bool_and(regexp_full_match(v, '-?\d+')), 'INTEGER', if(bool_and(regexp_full_match(v, '-?\d+(\.\d+)?')), 'DECIMAL(10,2)', 'VARCHAR')) as t, string_agg(v, ' | ' order by v) filter (k <= 3) as samples from d where k <= 10 group by 1)
  select x.c as column_name, count(*) as n_rows, count(v) as non_null, count(distinct v) as distinct_values, any_value(t) as suggested_type, any_value(samples) as samples from x join s on s.c = x.c group by 1""")
# The tree has one level at every size, as the SQL states; deeper ones are tested by a loop.
add("i04_corpus_fingerprint", lambda t: op.corpus_fingerprint(cl.corpus_manifest(t["documents"]), depth=1), """
  with l as (select left(sha256(text), 1) as pre, doc_id || ':' || sha256(text) as line from documents), b as (select pre || ':' || sha256(string_agg(line, chr(10) order by line)) as line from l group by pre)
  select (select count(*) from documents) as documents, sha256(string_agg(line, chr(10) order by line)) as fingerprint from b""")
add("i05_full_model", lambda t: op.full_model(t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")), place(t, "full")), "select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total from orders group by 1")
add("i06_time_range_model", lambda t: daily(t).withColumn("day", F.col("day").cast("string")), """
  with e as (select event_id, value, cast(ts as date) as day from events) select event_id, value, cast(day as varchar) as day from e where day not between date '2024-01-08' and date '2024-01-12' and day between date '2024-01-01' and date '2024-01-31'
  union all select event_id, 1e0, cast(day as varchar) from e where day between date '2024-01-08' and date '2024-01-12' and day <> date '2024-01-09' and event_id % 3 > 0""")
OLD = lambda t: t["customer"].where("c_custkey % 13 <> 0").select("c_custkey", "c_acctbal", F.lit(2).alias("version"))
NEW = lambda t: t["customer"].where("c_custkey % 11 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, 3).otherwise(1).alias("version"))
BOTH = "o as (select c_custkey, c_acctbal, 2 as version from customer where c_custkey % 13 <> 0), n as (select c_custkey, if(c_custkey % 5 > 0, c_acctbal, null) as c_acctbal, if(c_custkey % 2 = 0, 3, 1) as version from customer where c_custkey % 11 <> 0)"
add("i07_unique_key_model", lambda t: op.unique_key_model(OLD(t), NEW(t), ["c_custkey"], "version"), f"with {BOTH} select * from (select * from o union all select * from n) qualify row_number() over (partition by c_custkey order by version desc) = 1")
ACTION = "case when o.c_custkey is null then 'INSERT' when n.c_custkey is null then 'DELETE' when o.c_acctbal is not distinct from n.c_acctbal and o.version = n.version then 'UNCHANGED' else 'UPDATE' end"
same = lambda df: df.withColumn("version", F.when(F.col("c_custkey") % 4 == 0, 9).otherwise(F.col("version")))
SAME = BOTH.replace("2 as version", "if(c_custkey % 4 = 0, 9, 2) as version").replace("if(c_custkey % 2 = 0, 3, 1) as version", "if(c_custkey % 4 = 0, 9, if(c_custkey % 2 = 0, 3, 1)) as version")
add("i08_merge", lambda t: op.merged(same(OLD(t)), same(NEW(t)), ["c_custkey"]), f"with {SAME} select coalesce(n.c_custkey, o.c_custkey) as c_custkey, if(n.c_custkey is null, o.c_acctbal, n.c_acctbal) as c_acctbal, coalesce(n.version, o.version) as version, {ACTION} as _action from o full join n on n.c_custkey = o.c_custkey")
add("i08_action_counts", lambda t: op.action_counts(op.merged(same(OLD(t)), same(NEW(t)), ["c_custkey"])), f"with {SAME} select {ACTION} as _action, count(*) as n from o full join n on n.c_custkey = o.c_custkey group by 1")
add("i11_fact_rows", lambda t: op.fact_rows(t["part"].select("p_partkey", F.col("p_type").alias("kind"), "p_size", (F.col("p_partkey") % 50).alias("slot")), rg.surrogate_keys(t["part"], "p_type"), "kind", ["slot"], "p_partkey"), """
  with d as (select p_type as name, row_number() over (order by p_type) as id from (select distinct p_type from part)), f as (select p_partkey, p_type as kind, p_size, p_partkey % 50 as slot from part qualify row_number() over (partition by p_partkey % 50 order by p_partkey desc) = 1)
  select p_partkey, p_size, slot, id as kind_id from f join d on d.name = f.kind""")

CATALOG = lambda t: t["customer"].select((F.col("c_custkey") % 40).alias("table_name"), F.concat(F.element_at(F.array(*[F.lit(x) for x in ("order_", "home_address_", "email_", "passport_", "password_", "cell_no_", "surname_")]), (F.col("c_custkey") % 7 + 1).cast("int")), F.col("c_custkey")).alias("column_name"))
STRATEGY = "case c_custkey % 7 when 0 then 'none' when 1 then 'redact' when 3 then 'hash' when 4 then 'redact' else 'partial' end"
add("k05_suggested_masks", lambda t: cl.suggested_masks(CATALOG(t)), f"select c_custkey % 40 as table_name, (['order_', 'home_address_', 'email_', 'passport_', 'password_', 'cell_no_', 'surname_'])[c_custkey % 7 + 1] || c_custkey as column_name, {STRATEGY} as masking_strategy from customer")
add("k05_mask_coverage", lambda t: cl.mask_coverage(cl.suggested_masks(CATALOG(t)), CATALOG(t).withColumn("status", F.when(F.col("table_name") % 2 == 0, "active").otherwise("static"))), f"select {STRATEGY} as masking_strategy, count(*) as columns, count(*) filter (c_custkey % 40 % 2 = 0) as covered from customer group by 1")
add("v04_normalized_names", lambda t: cl.normalize_names(t["region"].select(F.col("r_regionkey").alias("Region Key!"), F.col("r_name").alias(" Name (long) "))), "select r_regionkey as region_key, r_name as name_long from region")
add("v07_subset_report", lambda t: cl.subset_report(t["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal"))), ["c_name", "c_acctbal", "c_none"]), """
  select 'kept' as state, 'c_name' as column_name, count(c_name) as n_values from customer union all select 'kept', 'c_acctbal', count(c_acctbal) filter (c_custkey % 5 > 0) from customer union all select 'missing', 'c_none', 0
  union all select 'dropped', 'c_custkey', count(c_custkey) from customer union all select 'dropped', 'c_nationkey', count(c_nationkey) from customer union all select 'dropped', 'c_mktsegment', count(c_mktsegment) from customer""")
add("v09_mapped_domains", lambda t: rg.mapped_domain(t["customer"].select("c_custkey", F.concat(F.lit(" U"), "c_custkey", F.lit("@Mail.N"), F.col("c_nationkey"), F.lit(".com ")).alias("address")), t["nation"].where("n_nationkey < 10").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".com")).alias("domain"), F.col("n_name").alias("name"))), """
  select c_custkey, 'u' || c_custkey || '@mail.n' || c_nationkey || '.com' as address, 'n' || c_nationkey || '.com' as domain, coalesce(if(c_nationkey < 10, n_name, null), 'n' || c_nationkey || '.com') as organization from customer left join nation on n_nationkey = c_nationkey""")
add("o16_open_work_orders", lambda t: rg.open_work_orders(t["order_line"].select(F.col("order_id").alias("base_id"), F.lit(0).alias("sub_id"), F.col("line_no").alias("lot_id"), F.lit(0).alias("split_id"), F.element_at(F.array(*map(F.lit, "RFUC")), (F.col("order_id") % 4 + 1).cast("int")).alias("status"))), """
  select order_id as base_id, 0 as sub_id, line_no as lot_id, 0 as split_id, (['R', 'F', 'U'])[order_id % 4 + 1] as status, order_id || '/' || line_no as wo_number, (['Released', 'Firmed', 'Unreleased'])[order_id % 4 + 1] as status_name from {order_line} where order_id % 4 < 3""")
usage = lambda t: t["lineitem"].select((F.col("l_partkey") % 300).alias("table_name"), (F.col("l_suppkey") % 20).alias("file"))
add("n08_usage_statistics", lambda t: rg.usage_statistics(usage(t)), "select l_partkey % 300 as table_name, count(*) as uses, count(distinct l_suppkey % 20) as files, round(100 * count(*) / (select count(*) from lineitem), 4) as share_pct from lineitem group by 1")
declared = lambda t: t["order_line"].select((F.col("order_id") % 500).alias("query"), F.concat(F.lit("t"), F.col("part_id") % 30).alias("from_table"), F.concat(F.lit("t"), F.col("supplier_id") % 30).alias("to_table"), F.when(F.col("line_no") % 3 == 0, "1:N").when(F.col("line_no") % 3 == 1, "N:1").otherwise("1:1").alias("cardinality"))
DECLARED = "j as (select order_id % 500 as query, 't' || part_id % 30 as from_table, 't' || supplier_id % 30 as to_table, (['1:N', 'N:1', '1:1'])[line_no % 3 + 1] as cardinality from {order_line})"
add("n09_fan_out", lambda t: g.fan_out(declared(t), declared(t).where("query % 2 = 0").select("query", F.col("from_table").alias("table_name"))), f"""
  with {DECLARED}, m as (select query, count(*) as to_many from j where cardinality in ('1:N', 'N:N') group by 1), a as (select query, count(distinct from_table) as aggregated_tables from j where query % 2 = 0 group by 1) select m.query, to_many, aggregated_tables from m join a on a.query = m.query where to_many >= 2 and aggregated_tables >= 2""")
add("n09_bridge_tables", lambda t: g.bridge_tables(declared(t)), f"with {DECLARED}, m as (select distinct from_table, to_table from j where cardinality = '1:N') select a.from_table as left_table, b.from_table as right_table, a.to_table as bridge from m a join m b on a.to_table = b.to_table and a.from_table < b.from_table")
links = lambda t: t["lineitem"].select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
add("n04_top_node", lambda t: g.top_node(links(t)), "with e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem), d as (select a as id, count(*) as degree from (select a, b from e union all select b, a from e) group by 1) select id, degree, round(degree / ((select count(*) from d) - 1), 6) as centrality from d order by degree desc, id limit 1")
field = lambda t: t["part"].select(F.concat(F.lit("t"), F.col("p_partkey") % 12).alias("table_name"), F.concat(F.lit("f"), "p_size").alias("field_name"), F.concat(F.lit("c"), F.col("p_partkey") % 40).alias("concept")).distinct()
FIELD = "cf as (select distinct 't' || p_partkey % 12 as table_name, 'f' || p_size as field_name, 'c' || p_partkey % 40 as concept from part)"
EDGE = "pe as (select distinct 'v' || n_regionkey as perspective, 'c' || n_nationkey as concept, if(n_nationkey % 3 = 0, 'USES_DEFINITION', 'ELEVATES') as relationship, if(n_nationkey % 2 = 0, 1.0, 0.5) as weight, n_nationkey % 4 as priority from nation)"
edge = lambda t: t["nation"].select(F.concat(F.lit("v"), "n_regionkey").alias("perspective"), F.concat(F.lit("c"), "n_nationkey").alias("concept"), F.when(F.col("n_nationkey") % 3 == 0, "USES_DEFINITION").otherwise("ELEVATES").alias("relationship"), F.when(F.col("n_nationkey") % 2 == 0, 1.0).otherwise(0.5).alias("weight"), (F.col("n_nationkey") % 4).alias("priority")).distinct()
sets = lambda t: t["lineitem"].select((F.col("l_orderkey") % 200).alias("set_id"), F.concat(F.lit("t"), F.col("l_partkey") % 12).alias("table_name"), F.concat(F.lit("f"), F.col("l_quantity").cast("int")).alias("field_name"))
add("n10_intent_scores", lambda t: se.intent_scores(sets(t), field(t), t["nation"].select(F.concat(F.lit("i"), F.col("n_nationkey") % 6).alias("intent"), F.concat(F.lit("c"), "n_nationkey").alias("concept"), F.when(F.col("n_nationkey") % 4 > 0, 1.0).otherwise(0.0).alias("weight")), t["nation"].select(F.concat(F.lit("i"), F.col("n_nationkey") % 6).alias("intent"), F.concat(F.lit("v"), "n_regionkey").alias("perspective"), F.lit(1.0).alias("weight")).distinct(), edge(t).select("perspective", "concept")), f"""
  with {FIELD}, {EDGE}, fs as (select distinct l_orderkey % 200 as set_id, 't' || l_partkey % 12 as table_name, 'f' || cast(l_quantity as int) as field_name from lineitem), n as (select set_id, count(*) as total from fs group by 1),
  r as (select distinct 'i' || n_nationkey % 6 as intent, table_name, field_name from nation join (select distinct 'i' || n_nationkey % 6 as intent, 'v' || n_regionkey as perspective from nation) ip on ip.intent = 'i' || n_nationkey % 6 join (select distinct perspective, concept from pe) pc on pc.perspective = ip.perspective and pc.concept = 'c' || n_nationkey join cf on cf.concept = pc.concept where n_nationkey % 4 > 0),
  m as (select set_id, intent, count(*) as matched from fs join r using (table_name, field_name) group by 1, 2) select m.set_id, intent, matched, round(matched / total, 3) as confidence from m join n on n.set_id = m.set_id""")
add("n11_elevated_fields", lambda t: se.elevated_fields(edge(t), field(t)), f"with {FIELD}, {EDGE} select distinct perspective, pe.concept, table_name, field_name, priority from pe join cf on cf.concept = pe.concept where relationship = 'ELEVATES' or weight = 1")
ENTITIES = ["license", "data", "permission", "email"]
vectors = lambda t: t["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
add("n13_graph_search", lambda t: se.graph_search(vectors(t), vectors(t).where("id % 20 = 0"), t["documents"].select("doc_id", "text"), ENTITIES, 3), """
  with x as (select vec_id as id, cast(embedding as double[]) as v from embeddings), s as (select a.id as query_id, b.id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) as similarity from x a join x b on a.id <> b.id where a.id % 20 = 0),
  r as (select *, cast(row_number() over (partition by query_id order by similarity desc, id) as int) as rank from s), e as (select doc_id, unnest(list_filter([""" + ", ".join(f"if(contains(lower(text), '{e}'), {n}, null)" for n, e in enumerate(ENTITIES)) + """], lambda z: z is not null)) as entity from documents),
  o as (select a.doc_id, b.doc_id as other, min(a.entity) as entity from e a join e b on a.entity = b.entity and a.doc_id <> b.doc_id group by 1, 2), l as (select doc_id, string_agg(other, ',' order by n) as related_docs from (select *, row_number() over (partition by doc_id order by entity, other) as n from o) where n <= 3 group by 1)
  select query_id, id, similarity, rank, coalesce(related_docs, '') as related_docs from r left join l on doc_id = id where rank <= 3""")
entry = lambda t: t["part"].select((F.col("p_partkey") % 10).alias("doc_id"), F.col("p_partkey").alias("line_no"), F.when(F.col("p_partkey") % 9 == 0, F.lit("prose without a term")).otherwise(F.concat(F.col("p_type"), F.lit(" "), F.col("p_size") % 4, F.when(F.col("p_size") % 2 == 0, F.lit(" (ABC) ★")).otherwise(""), F.lit(" — meaning "), F.col("p_partkey"))).alias("value"))
add("n15_glossary", lambda t: se.glossary(entry(t)), """
  select p_partkey % 10 as doc_id, p_type || ' ' || p_size % 4 as term, if(p_size % 2 = 0, 'ABC', '') as acronym, p_size % 2 = 0 as foundational, 'meaning ' || p_partkey as definition, trim(regexp_replace(lower(p_type || ' ' || p_size % 4), '[^a-z0-9]+', '-', 'g'), '-') as slug
  from part where p_partkey % 9 > 0 qualify row_number() over (partition by p_partkey % 10, p_type || ' ' || p_size % 4 order by p_partkey) = 1""")
add("n18_coverage_gaps", lambda t: se.coverage_gaps(edge(t), t["nation"].select(F.concat(F.lit("c"), "n_nationkey").alias("concept"), F.when(F.col("n_nationkey") % 2 == 0, "approved").otherwise("draft").alias("status"))), f"with {EDGE} select concept, perspective, relationship, weight, priority from pe where cast(substr(concept, 2) as int) % 2 = 1")
add("n18_undescribed", lambda t: se.undescribed(field(t).withColumn("description", F.when(F.substring("concept", -1, 1) != "3", F.col("concept")))), f"with {FIELD} select table_name, count(*) as fields, count(*) filter (concept like '%3') as undescribed from cf group by 1")
TERMS = [("MIT", "Massachusetts licence", "legal"), ("GPL", "General Public License", "legal"), ("API", "programming interface", "software"), ("AND", "conjunction", "language"), ("THE", "article", "language")]
add("n19_tagged", lambda t: se.tagged(t["documents"], t.spark.createDataFrame(TERMS, "acronym string, full_name string, domain string")), r"""
  with d as (select * from (values ('MIT', 'Massachusetts licence', 'legal'), ('GPL', 'General Public License', 'legal'), ('API', 'programming interface', 'software'), ('AND', 'conjunction', 'language'), ('THE', 'article', 'language')) v(acronym, full_name, domain)),
  w as (select distinct doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{2,6})\b', 1)) as acronym from documents) select doc_id, w.acronym, full_name, domain from w join d on d.acronym = w.acronym""")
add("a09_metric_template", lambda t: (lambda df: df.groupBy("s_supplier_name").agg(F.round(F.sum(se.metric(df, "{amount} * (1 - {discount})", {"amount": "l_amount", "discount": "l_discount"}).cast("decimal(28,6)")), 2).cast("double").alias("net_value")))(se.joined_by_keys({"l": t["order_line"], "s": t["suppliers"]}, [("l", "supplier_id", "s", "supplier_id")])), "select supplier_name as s_supplier_name, cast(round(sum(cast(amount * (1 - discount) as decimal(28, 6))), 2) as double) as net_value from {order_line} l join {suppliers} s on s.supplier_id = l.supplier_id group by 1")
QUERIES, ORACLES = plans.queries, plans.oracles
