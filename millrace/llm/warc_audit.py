"""WARC: Merkle fixity audit of two replicas of an archive.

Pages become WARC response records; an archive file holds the records of `file_ids` consecutive ids, at offsets that are
running sums of their lengths. A record's leaf is the SHA-256 of its bytes; records of one offset range (`range_bytes`)
hash, in order, into a range node, and 16 neighbours into a node of the next level, up to one root. Replicas whose roots
agree are alike. Else only the children of nodes that differ are read, level by level, down to the ranges, and only the
records of those ranges are compared: altered, missing (not in the replica) or extra (only in the replica).

Only the primary has offsets. Of it the first record of each range is sent on, and a record of the replica belongs to the
last range of its file that begins at or before it: no record meets its twin before its range is known to differ.

Scale: record bytes are hashed where they are read and never shuffled; what is shuffled are digests, by file. Groups are
bounded: a file has the records of `file_ids` ids, a range at most range_bytes / (least record) of them, a node 16
children; levels shrink by 16. Nodes are (file, number) pairs, so ids of any size fit.

Defined cases: null url and html are empty; rows with a null page_id are told apart by their digests, from which they
get a file of negative number, and are reported with a null page_id; rows that share a page_id are told apart by
their order (url, then digest); empty tables have no tree and no differences. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release

FANOUT = 16


def record_bytes() -> Column:
    """A WARC response record (ISO 28500) of a page."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def floor_div(c: str, n: int) -> Column:
    """Whole-number division that rounds down, for any long."""
    return F.expr(f"{c} div {n} - if({c} % {n} < 0, 1, 0)")


def records(pages: DataFrame, file_ids: int) -> DataFrame:
    """page_id, id (page_id, or of the digest), nth (among rows of one id), file_no, length and digest of every record."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "html").withColumn("record", record_bytes())
    out = out.select("page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    out = out.withColumn("id", F.coalesce("page_id", F.xxhash64("digest"))).withColumn("nameless", F.col("page_id").isNull())
    nth = F.row_number().over(Window.partitionBy("nameless", "id").orderBy("url", "digest"))
    return out.select("page_id", "nameless", "id", nth.alias("nth"), floor_div("id", file_ids).alias("file_no"), "length", "digest")


FILE = ["nameless", "file_no"]


def with_offsets(found: DataFrame, range_bytes: int) -> DataFrame:
    """Adds the offset in its file, and the number of the record's offset range there."""
    before = Window.partitionBy(*FILE).orderBy("id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    at = found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return at.withColumn("range_no", F.expr(f"offset div {range_bytes}"))


def in_ranges(found: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds range_no: of the last range of the record's file that begins at or before it, 0 where there is none."""
    marks = starts.select(*FILE, "id", "nth", "range_no", F.lit(0).alias("kind"))
    both = found.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    last = F.last("range_no", ignorenulls=True).over(Window.partitionBy(*FILE).orderBy("id", "nth", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("range_no", F.coalesce(last, F.lit(0).cast("long"))).where("kind = 1").drop("kind")


def ordered_hash(order: list[str], digest: str) -> Column:
    """SHA-256 over the digests of a group in order; null if it has none."""
    rows = F.sort_array(F.collect_list(F.when(F.col(digest).isNotNull(), F.struct(*order, digest))))
    joined = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[r[c].cast("string") for c in order], r[digest])), "|")
    return F.when(F.count(digest) > 0, F.sha2(joined, 256))


def differs() -> Column:
    return ~F.col("a").eqNullSafe(F.col("b"))


def level_up(nodes: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The nodes above: 16 neighbours, which agree in `keys`, hash in order of their number."""
    up = nodes.groupBy(*keys, floor_div(number, FANOUT).alias("up"))
    return materialize(up.agg(ordered_hash([number], "a").alias("a"), ordered_hash([number], "b").alias("b")).withColumnRenamed("up", number), "tree")


def audit(primary: DataFrame, replica: DataFrame, file_ids: int = 1000, range_bytes: int = 1 << 16) -> DataFrame:
    """One row per record that differs: page_id, nth, kind, file_no, offset and length (in the primary, null if extra),
    primary_sha256 and replica_sha256."""
    a = materialize(with_offsets(records(primary, file_ids), range_bytes), "primary")
    starts = a.groupBy(*FILE, "range_no").agg(F.min(F.struct("id", "nth")).alias("x")).select(*FILE, "range_no", "x.id", "x.nth")
    b = materialize(in_ranges(records(replica, file_ids), starts), "replica")
    side = lambda df, name: df.groupBy(*FILE, "range_no").agg(ordered_hash(["id", "nth"], "digest").alias(name))
    levels = [(materialize(side(a, "a").join(side(b, "b"), [*FILE, "range_no"], "full"), "tree"), "range_no")]
    while levels[-1][0].where("range_no <> 0").limit(1).count():  # ranges of a file, up to the file
        levels.append((level_up(levels[-1][0], FILE, "range_no"), "range_no"))
    levels.append((levels[-1][0].drop("range_no"), "file_no"))
    while levels[-1][0].where("file_no not in (-1, 0)").limit(1).count():  # files, up to the root of those below 0 and of the others
        levels.append((level_up(levels[-1][0], ["nameless"], "file_no"), "file_no"))
    top, _ = levels[-1]
    open_nodes = top.where(differs())
    for (below, number), (above, of_above) in zip(reversed(levels[:-1]), reversed(levels[1:])):
        keys = [c for c in (*FILE, "range_no") if c in above.columns]
        same = of_above == number  # else a file and its ranges' root, which are one node
        parent = open_nodes.select(*[F.col(c).alias(f"up_{c}") for c in keys])
        meets = [F.col(c) == F.col(f"up_{c}") for c in keys if not (same and c == number)]
        if same:
            meets.append(floor_div(number, FANOUT) == F.col(f"up_{number}"))
        open_nodes = below.join(parent, meets, "left_semi").where(differs())
    ranges = materialize(open_nodes.select(*FILE, "range_no"), "ranges")
    release(*[x for x, _ in levels if hasattr(x, "_written_at")])
    key = ["nameless", "id", "nth"]
    left = a.join(ranges, [*FILE, "range_no"], "left_semi").select(*key, F.col("file_no").alias("a_file"), "offset", "length", F.col("digest").alias("primary_sha256"))
    right = b.join(ranges, [*FILE, "range_no"], "left_semi").select(*key, F.col("file_no").alias("b_file"), F.col("digest").alias("replica_sha256"))
    both = left.join(right, key, "full").where(~F.col("primary_sha256").eqNullSafe(F.col("replica_sha256")))
    kind = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("primary_sha256").isNull(), "extra").otherwise("altered")
    return both.select(F.when(~F.col("nameless"), F.col("id")).alias("page_id"), "nth", kind.alias("kind"), F.coalesce("a_file", "b_file").alias("file_no"), "offset", "length", "primary_sha256", "replica_sha256")
