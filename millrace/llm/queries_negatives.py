"""Query of the hard-negative mining and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives
from .common import table


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
#: The same rows by scoring every row against every anchor; for small tables.
NEGATIVES_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select p.*, s.id as negative_id, s.score as negative_score, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as int) as "rank"
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, "rank", negative_id, positive_score, negative_score from n where "rank" <= 10
"""
ORACLES = {"op12_hard_negatives": NEGATIVES_SQL}
