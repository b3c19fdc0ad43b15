"""URL filters: a temporal list join, in DataFrame and SQL functions only.

List entries are dated: from `since` on, an entry's verdict (block, allow, or remove, which ends it) holds for its
pattern, a domain ("example.com", with all below it) or a directory of a host ("example.com/en"). The entries of a
pattern become validity intervals; each capture is joined with the intervals of its host's domains and of its url's
directories that were valid when it was fetched. The longest valid pattern decides; of one pattern's entries with one
date block goes before allow, allow before remove.

Scale: equal captures are evaluated once. The join is on the pattern and a salt, with the interval as a further
condition: a pattern that a third of all captures share is dealt over `salts` places, to each of which its intervals
are copied. The aggregate after it is by capture, of at most (labels of the host + directories) rows.

Defined cases: a null url or one without a host has no pattern and the verdict "none"; with a null fetch date nothing
is valid; entries without pattern, date or verdict are ignored; repeated captures are all returned. Only page_id, url
and fetched are read, and pattern, verdict and since of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def patterns_of(host: Column, url: Column) -> Column:
    """The domains of a host, and the directories of the url below it."""
    labels = F.split(host, r"\.")
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    directories = F.transform(folders, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(folders, 1, i + 1), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, directories)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, verdict, since and until (exclusive) of the entries that are in force for a while."""
    rank = F.when(F.col("verdict") == "block", 0).when(F.col("verdict") == "allow", 1).otherwise(2)
    known = entries.where("pattern is not null and since is not null and verdict is not null").select("pattern", "verdict", "since")
    first = F.row_number().over(Window.partitionBy("pattern", "since").orderBy(rank))
    dated = known.withColumn("first", first).where("first = 1")
    until = F.lead("since", 1).over(Window.partitionBy("pattern").orderBy("since"))
    return dated.withColumn("until", F.coalesce(until, F.lit(FOREVER).cast("date"))).where("verdict <> 'remove'").drop("first")


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """page_id, url, fetched, host, verdict (block, allow or none) and the pattern that decided, of every capture."""
    once = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("times"))
    keyed = once.withColumn("host", host_of(F.coalesce("url", F.lit("")))).select("*", F.explode_outer(patterns_of(F.col("host"), F.col("url"))).alias("key"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(salts)).cast("int"))
    valid = intervals(entries).withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = keyed.join(valid, (F.col("key") == F.col("pattern")) & (F.col("salt") == F.col("of_salt")) & (F.col("since") <= F.col("fetched")) & (F.col("fetched") < F.col("until")), "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "pattern", "verdict"))).alias("best")
    decided = joined.groupBy("page_id", "url", "fetched", "host", "times").agg(best)
    return decided.select("page_id", "url", "fetched", "host", F.coalesce("best.verdict", F.lit("none")).alias("verdict"), "best.pattern", F.explode(F.sequence(F.lit(1), "times")).alias("nth")).drop("nth")
