"""Query of the phrase collocations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations
from .common import table


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("path_words")


QUERIES = {"op11_collocations": op11_collocations}
#: The same rows by counting the phrases of every length at every place; for small tables.
PHRASES_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (
  select lang, len, array_to_string(w[i:i + len - 1], ' ') as phrase
  from (select lang, w, len, unnest(range(1, len(w) - len + 2)) as i from w, (select unnest([1, 2, 3, 4]) as len) where len(w) >= len)),
f as (select lang, len, phrase, count(*) as f, string_split(phrase, ' ') as w from g group by all),
n as (select lang, sum(f) as n from f where len = 1 group by 1),
c as (select * from f where len > 1 and f >= 30),
inside as (
  select lang, phrase, max(f) as most
  from (select lang, f, array_to_string(w[i:i + s - 1], ' ') as phrase
        from (select lang, f, w, s, unnest(range(1, len - s + 2)) as i from c, (select unnest([2, 3]) as s) where s < len))
  group by all),
cut as (
  select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, cast(cast(2000000 as hugeint) * c.f // (x.f + y.f) as bigint) as score
  from (select *, unnest(range(1, c.len)) as k from c) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:c.len], ' ')),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select low.* from low left join inside i on i.lang = low.lang and i.phrase = low.phrase where i.most is null or 100 * i.most < 80 * low.a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as "rank", phrase, a, l, r, cast(n as bigint) as n, score
from kept join n using (lang) qualify "rank" <= 2000
"""
ORACLES = {"op11_collocations": PHRASES_SQL}
