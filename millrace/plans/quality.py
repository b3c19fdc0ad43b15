"""Registered cleansing, masking and statistics queries."""

from millrace.operators import cleansing as cl
from millrace.operators import statistics as st
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
add = plans.add
SALT = "plant-7"
#: A policy as the masking matrix holds it.
POLICY = [
    {"table_name": "customer", "column_name": "c_name", "masking_mode": 1, "status": "active", "field_length": 12},
    {"table_name": "customer", "column_name": "c_mktsegment", "masking_mode": 3, "status": "active", "field_length": 8},
    {"table_name": "customer", "column_name": "c_acctbal", "masking_mode": 2, "status": "active", "field_length": 8},
    {"table_name": "customer", "column_name": "c_nationkey", "masking_mode": 1, "status": "static", "field_length": 8},
]
HASH = "upper(sha256({0} || 'plant-7'))"

add("v03_cleanse", lambda t: cl.cleanse(t["orders"].select(F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("  x "))).alias("priority"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("double")).alias("cust"))), """
  with x as (select if(o_orderkey % 5 > 0, trim(regexp_replace('  ' || o_orderpriority || '  x ', '\\s+', ' ', 'g')), null) as p, if(o_orderkey % 7 > 0, cast(o_custkey as double), null) as c from orders)
  select distinct coalesce(p, 'Unknown') as priority, coalesce(c, (select median(c) from x)) as cust from x""")
add("v05_outliers", lambda t: cl.outliers(t["events"].select("value"), k=1.0), """
  with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
  select 'value' as column_name, count(*) filter (value < a - (b - a) or value > b + (b - a)) as outliers from events, q""")
add("v06_coerce", lambda t: cl.coerce(t["events"].select("event_id", F.concat(F.lit("9"), F.col("event_type")).alias("bad"), F.col("user_id").cast("string").alias("good")), {"bad": "int", "good": "int"}), "select event_id, cast(null as int) as bad, cast(user_id as int) as good from events")
add("v08_cleansing_report", lambda t: cl.cleansing_report(t["customer"].select("c_mktsegment", F.when(F.col("c_acctbal") > 0, 1).alias("positive"))), """
  select 'rows' as metric, count(*) as value from customer union all select 'nulls:c_mktsegment', count(*) filter (c_mktsegment is null) from customer
  union all select 'nulls:positive', count(*) filter (c_acctbal <= 0) from customer union all select 'distinct_rows', count(*) from (select distinct c_mktsegment, c_acctbal > 0 from customer)""")
add("k01_hash_mask", lambda t: t["customer"].select("c_custkey", cl.hash_mask(F.col("c_name"), SALT).alias("masked")), f"select c_custkey, if(c_name = '', c_name, left({HASH.format('c_name')}, 16)) as masked from customer")
add("k03_apply_policy", lambda t: cl.apply_policy(t["customer"], "customer", POLICY, SALT), f"""
  select c_custkey, left({HASH.format('c_name')}, 12) as c_name, c_nationkey, cast(null as varchar) as c_acctbal, '0x' || left({HASH.format('c_mktsegment')}, 8) as c_mktsegment from customer""")
add("k04_masked_extract", lambda t: cl.masked_extract(t["customer"], "customer", POLICY, SALT), f"""
  select 'customer' as table_name, 'c_name' as column_name, cast(1 as int) as masking_mode, left({HASH.format('c_name')}, 12) as masked_value from customer
  union all select 'customer', 'c_mktsegment', 3, '0x' || left({HASH.format('c_mktsegment')}, 8) from customer union all select 'customer', 'c_acctbal', 2, null from customer""")
# the patterns of an address, a social security number and a telephone number with or without country code, brackets and blanks
EMAIL, SSN, PHONE = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", r"\b\d\d\d-\d\d-\d\d\d\d\b", r"\b(?:\+?1[\s.-]?)?(?:\(?\d\d\d\)?[\s.-]?)\d\d\d[\s.-]?\d\d\d\d\b"
add("k06_personal_data", lambda t: cl.personal_data(t["documents"]), f"""
  with x as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{EMAIL}')) as e, len(regexp_extract_all(coalesce(text, ''), '{SSN}')) as s, len(regexp_extract_all(coalesce(text, ''), '{PHONE}')) as p from documents)
  select doc_id, cast(e as int) as email, cast(s as int) as ssn, cast(p as int) as phone, if(e + s + p > 0, 'blocked_pii', 'ingested') as status from x""")
add("i04_corpus_manifest", lambda t: cl.corpus_manifest(t["documents"]), f"""
  select doc_id, sha256(text) as sha256, if(regexp_matches(text, '{EMAIL}|{SSN}|{PHONE}'), 'blocked_pii', 'ingested') as status from documents""")
add("v01_model_audit", lambda t: cl.audit(t["lineitem"], ["l_orderkey"], ["l_shipdate", "l_tax"], {"whole": "l_quantity <= 45", "known flag": "l_returnflag in ('A', 'N')"}), """
  select 'not_null:l_shipdate' as rule, count(*) filter (l_shipdate is null) as violations from lineitem union all select 'not_null:l_tax', count(*) filter (l_tax is null) from lineitem
  union all select 'predicate:whole', count(*) filter (l_quantity > 45) from lineitem union all select 'predicate:known flag', count(*) filter (l_returnflag not in ('A', 'N')) from lineitem
  union all select 'unique:l_orderkey', count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)""")
NEW = lambda t: t["customer"].where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
OLD = lambda t: t["customer"].where("c_custkey % 13 <> 0")
ACTION = "case when c_custkey % 13 = 0 then {0} when c_custkey % 11 = 0 then {1} when c_custkey % 5 = 0 then {2} else {3} end"
add("i07_upsert", lambda t: cl.upsert(OLD(t), NEW(t).union(NEW(t).withColumn("c_acctbal", F.lit(-1e9))), ["c_custkey"], "c_acctbal"), "select c_custkey, c_name, c_nationkey, if(c_custkey % 11 <> 0 and c_custkey % 5 = 0, -1e9, c_acctbal) as c_acctbal, c_mktsegment from customer where c_custkey % 143 <> 0")
add("i08_changes", lambda t: cl.changes(OLD(t), NEW(t), ["c_custkey"]), f"select c_custkey, {ACTION.format(chr(39)+'INSERT'+chr(39), chr(39)+'DELETE'+chr(39), chr(39)+'UPDATE'+chr(39), chr(39)+'UNCHANGED'+chr(39))} as _action from customer where c_custkey % 143 <> 0")
add("i09_parity", lambda t: cl.parity(OLD(t), NEW(t), ["c_custkey"]), f"select {ACTION.format(chr(39)+'extra'+chr(39), chr(39)+'missing'+chr(39), chr(39)+'different'+chr(39), chr(39)+'same'+chr(39))} as state, count(*) as n from customer where c_custkey % 143 <> 0 group by 1")
add("i10_stale_prune", lambda t: t["lineitem"].select("l_orderkey", "l_partkey").distinct().join(t["part"].where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti"), "select distinct l_orderkey, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)")

DAYS = """(select l_linestatus as series, cast(l_shipdate as date) as day, count(*) as total, count(*) filter (l_returnflag = 'R') as defects, row_number() over (partition by l_linestatus order by cast(l_shipdate as date)) as i,
  count(*) filter (l_returnflag = 'R') / count(*) as rate from lineitem group by 1, 2)"""
days = lambda t: st.series_of(t["lineitem"])
add("a01_proportion_interval", lambda t: st.proportion_interval(days(t), "defects", "total").select("series", F.col("day").cast("string").alias("day"), "rate", "ci_low", "ci_high"), f"""
  with x as (select *, if(rate <= 0 or rate >= 1, 1.96e0 * sqrt(1 / (4 * total)), 1.96e0 * sqrt(rate * (1 - rate) / total)) as h from {DAYS} d)
  select series, cast(day as varchar) as day, round(rate, 6) as rate, round(greatest(rate - h, 0), 6) as ci_low, round(least(rate + h, 1), 6) as ci_high from x""")
add("a02_daily_significance", lambda t: st.daily_significance(days(t), "defects", "total").withColumn("day", F.col("day").cast("string")), f"""
  with o as (select series, sum(defects) / sum(total) as p from {DAYS} d group by 1), x as (select d.*, p, sqrt(p * (1 - p) / total) as se from {DAYS} d join o on o.series = d.series), y as (select *, (rate - p) / se as zz, abs((rate - p) / se) / sqrt(2) as u from x),
  w as (select *, 1 / (1 + 0.3275911e0 * u) as k from y),
  v as (select *, 1 - (k * (0.254829592e0 + k * (-0.284496736e0 + k * (1.421413741e0 + k * (-1.453152027e0 + k * 1.061405429e0))))) * exp(-u * u) as erf from w)
  select series, cast(day as varchar) as day, defects, total, round(zz, 4) as z, round(2 * (1 - (1 + erf) / 2), 4) as p_value, 2 * (1 - (1 + erf) / 2) < 0.05 as significant from v""")
add("a04_linear_trend", lambda t: st.linear_trend(days(t), "i", "rate").drop("p_value"), f"""
  with x as (select series, count(*) as n, regr_slope(rate, i) as s, regr_r2(rate, i) as r from {DAYS} d group by 1) select series, n, round(s, 6) as slope, round(r, 6) as r2, round(sign(s) * sqrt(r * (n - 2) / (1 - r)), 4) as t from x""")
add("a05_mann_kendall", lambda t: st.mann_kendall(days(t), "i", "rate").drop("p_value"), f"""
  with d as materialized (select * from {DAYS} x), s as (select a.series, cast(sum(sign(b.rate - a.rate)) as double) as s from d a join d b on a.series = b.series and a.i < b.i group by 1), n as (select series, count(*) as n from d group by 1),
  x as (select n.series, n, s, round(if(s > 0, s - 1, if(s < 0, s + 1, 0)) / sqrt(n * (n - 1) * (2 * n + 5) / 18), 4) as z from n join s on s.series = n.series)
  select series, n, s, z, if(abs(z) < 1.96, 'no trend', if(z > 0, 'increasing', 'decreasing')) as trend from x""")
# P-values of the t and normal distributions, which SQL lacks: plain integration in the tests states them.
add("a04_linear_trend_p", lambda t: st.linear_trend(days(t), "i", "rate"))
add("a05_mann_kendall_p", lambda t: st.mann_kendall(days(t), "i", "rate"))
add("a06_control_chart", lambda t: st.control_chart(days(t), "rate"), f"""
  with l as (select series, avg(rate) as m, stddev_samp(rate) as s from {DAYS} d group by 1)
  select d.series, round(any_value(m), 6) as mean, round(any_value(greatest(m - 3 * s, 0)), 6) as lcl, round(any_value(m + 3 * s), 6) as ucl, count(*) filter (rate < greatest(m - 3 * s, 0) or rate > m + 3 * s) as out_of_control,
    round(100 * avg(if(rate < greatest(m - 3 * s, 0) or rate > m + 3 * s, 0, 1)), 4) as in_control_pct from {DAYS} d join l on l.series = d.series group by 1""")
add("a07_overall", lambda t: st.overall(days(t), "defects", "total"), f"select series, round(sum(defects) / sum(total), 6) as rate, round(avg(rate), 6) as mean, round(stddev_pop(rate), 6) as sd, round(min(rate), 6) as low, round(max(rate), 6) as high from {DAYS} d group by 1")
add("a08_group_comparison", lambda t: st.group_comparison(t["events"], "event_type", "value", "view"), """
  with m as (select event_type as v, count(*) as n, avg(value) as m from events group by 1), b as (select m as b from m where v = 'view')
  select v as variant, n, round(m, 6) as mean, round(100 * (m - b) / b, 4) as change_pct, abs((m - b) / b) > 0.1 as significant from m, b""")
add("a08_composite", lambda t: st.composite(t["events"], "event_type", ["value", "user_id", "event_id"], "view"), """
  with m as (select event_type as v, count(*) as n, (avg(value) + avg(user_id) + avg(event_id)) / 3 as s from events group by 1), b as (select s as of_base from m where v = 'view')
  select v as variant, n, round(s, 6) as composite, round(abs(s - of_base) / greatest(s, of_base), 6) as confidence, abs(s - of_base) / greatest(s, of_base) > 0.1 as significant, v = (select v from m order by s desc, v = 'view' desc, v desc limit 1) as winner from m, b""")
add("a10_month_matrix", lambda t: st.month_matrix(t["lineitem"], "l_shipdate", "l_returnflag", ["A", "N", "R"]), "select strftime(l_shipdate, '%Y-%m') as month, count(*) filter (l_returnflag = 'A') as A, count(*) filter (l_returnflag = 'N') as N, count(*) filter (l_returnflag = 'R') as R from lineitem group by 1")
add("a11_word_counts", lambda t: st.word_counts(t["documents"]), r"""
  with w as (select unnest(string_split_regex(regexp_replace(lower(text), '[^\p{L}\s]', '', 'g'), '\s+')) as word from documents) select word, count(*) as n from w where length(word) >= 4 group by 1 order by 2 desc, 1 limit 100""")
QUERIES, ORACLES = plans.queries, plans.oracles
