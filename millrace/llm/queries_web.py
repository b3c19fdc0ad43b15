"""Queries of the WARC audit and the URL lists. What pages don't have (replicas, dated lists, fetch dates) is derived from
them by stated arithmetic, so that the work grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import temporal_lists, warc_audit
from .common import table


def second_replica(pages: DataFrame) -> DataFrame:
    """A replica with faults: some pages altered, some missing, some extra."""
    kept = pages.where("page_id % 193 <> 7").withColumn("html", F.when(F.expr("page_id % 97 = 5"), F.concat("html", F.lit(" "))).otherwise(F.col("html")))
    return kept.union(pages.where("page_id % 389 = 11").withColumn("page_id", -2 - F.col("page_id")))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_audit.audit(pages, second_replica(pages))


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries for the hosts of pages and for their first directories; dates follow from the least page of each."""
    hosts = pages.select("page_id", "url", temporal_lists.host_of(F.col("url")).alias("host")).where("host <> ''")
    domains = hosts.groupBy(F.col("host").alias("pattern")).agg(F.min("page_id").alias("m"))
    folders = hosts.select("page_id", F.concat("host", F.lit("/"), F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^/?#]+)/", 1)).alias("pattern")).where("pattern not like '%/'").groupBy("pattern").agg(F.min("page_id").alias("m"))
    entry = lambda df, verdict, where, day: df.where(where).select("pattern", F.lit(verdict).alias("verdict"), F.expr(f"date_add(date'2024-01-01', cast({day} as int))").alias("since"))
    parts = [
        entry(domains, "block", "m % 3 = 0", "(m * 7) % 200"),
        entry(domains, "remove", "m % 3 = 0", "(m * 7) % 200 + 60"),
        entry(domains, "block", "m % 9 = 0", "(m * 7) % 200 + 120"),
        entry(domains, "allow", "m % 4 = 1", "(m * 11) % 300"),
        entry(folders, "block", "m % 5 = 2", "(m * 5) % 300"),
        entry(folders, "allow", "m % 6 = 3", "(m * 3) % 300"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast((page_id * 13) % 365 as int))"))
    return temporal_lists.evaluate(captures, dated_list(pages)).drop("url").withColumn("fetched", F.col("fetched").cast("string"))


WARC_SQL = r"""
with rec as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as head,
    chr(13) || chr(10) || chr(13) || chr(10) as two
  from pages),
a as (select page_id, head || strlen(html) || two || html || two as record from rec),
p as (
  select page_id, strlen(record) as length, sha256(record) as digest, cast(floor(page_id / 1000.0) as bigint) as file_no,
    coalesce(sum(strlen(record)) over (partition by floor(page_id / 1000.0) order by page_id rows between unbounded preceding and 1 preceding), 0) as off
  from a),
b as (
  select page_id, sha256(head || strlen(h) || two || h || two) as digest
  from (select *, case when page_id % 97 = 5 then html || ' ' else html end as h from rec where page_id % 193 <> 7)
  union all
  select -2 - page_id, sha256(replace(head, '<urn:page:' || page_id || '>', '<urn:page:' || (-2 - page_id) || '>') || strlen(html) || two || html || two) from rec where page_id % 389 = 11)
select coalesce(p.page_id, b.page_id) as page_id, 1 as nth,
  case when b.digest is null then 'missing' when p.digest is null then 'extra' else 'altered' end as kind,
  coalesce(p.file_no, cast(floor(b.page_id / 1000.0) as bigint)) as file_no, cast(p.off as bigint) as "offset", p.length, p.digest as primary_sha256, b.digest as replica_sha256
from p full join b on p.page_id = b.page_id
where p.digest is distinct from b.digest
"""
LISTS_SQL = r"""
with c as (
  select page_id, date '2024-01-01' + cast((page_id * 13) % 365 as int) as fetched, url,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') as host,
    string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1), '/') as parts
  from pages),
d as (select host as pattern, min(page_id) as m from c where host <> '' group by 1),
f as (select pattern, min(page_id) as m from (select page_id, host || '/' || regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]+)/', 1) as pattern from c where host <> '') where pattern not like '%/' group by 1),
e as (
  select pattern, 'block' as verdict, (m * 7) % 200 as day from d where m % 3 = 0
  union all select pattern, 'remove', (m * 7) % 200 + 60 from d where m % 3 = 0
  union all select pattern, 'block', (m * 7) % 200 + 120 from d where m % 9 = 0
  union all select pattern, 'allow', (m * 11) % 300 from d where m % 4 = 1
  union all select pattern, 'block', (m * 5) % 300 from f where m % 5 = 2
  union all select pattern, 'allow', (m * 3) % 300 from f where m % 6 = 3),
one as (select pattern, day, min(case verdict when 'block' then 0 when 'allow' then 1 else 2 end) as v from e group by 1, 2),
i as (
  select pattern, case v when 0 then 'block' else 'allow' end as verdict, v, date '2024-01-01' + cast(day as int) as since,
    coalesce(date '2024-01-01' + cast(lead(day) over (partition by pattern order by day) as int), date '9999-12-31') as until
  from one),
k as (
  select page_id, fetched, host, unnest(list_transform(range(len(string_split(host, '.'))), lambda n: array_to_string(string_split(host, '.')[n + 1:], '.'))) as key from c where host <> ''
  union
  select page_id, fetched, host, unnest(list_transform(range(1, len(parts)), lambda n: host || '/' || array_to_string(parts[1:n], '/'))) as key from c where host <> ''),
hit as (
  select k.page_id, i.pattern, i.verdict, row_number() over (partition by k.page_id order by length(i.pattern) desc, i.pattern desc) as r
  from k join i on k.key = i.pattern and i.v < 2 and i.since <= k.fetched and k.fetched < i.until)
select c.page_id, cast(c.fetched as varchar) as fetched, c.host, coalesce(hit.verdict, 'none') as verdict, hit.pattern
from c left join hit on hit.page_id = c.page_id and hit.r = 1
"""
QUERIES = {"op3_url_lists": op3_url_lists, "op5_warc_audit": op5_warc_audit}
ORACLES = {"op3_url_lists": LISTS_SQL, "op5_warc_audit": WARC_SQL}
