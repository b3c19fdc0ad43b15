"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join
from .common import table


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), 4, 85, 100)


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
#: The same rows by counting shared shingles of every pair of documents that share any; for small tables.
JACCARD_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(if(len(w) >= 4, list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')), if(len(w) > 0, [array_to_string(w, ' ')], cast([] as varchar[])))) as g from w),
u as (select doc_id, unnest(g) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
both_ways as (select a, b from e union select b, a from e),
r as (select doc_id, doc_id as root from s union select r.doc_id, b from r join both_ways on a = r.root),
c as (select doc_id, min(root) as component_id from r group by 1)
select s.doc_id, cast(len(g) as bigint) as n_shingles, component_id from s join c on c.doc_id = s.doc_id
"""
ORACLES = {"op6_jaccard_join": JACCARD_SQL}
