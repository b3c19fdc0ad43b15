"""Registers and reshaping operators: balances by place, attribute rows to columns, latest rows, composed keys, text
splits, column profiles and surrogate keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.lineage import cut

from .running import running_sums


def site_balances(transaction: DataFrame) -> DataFrame:
    """Signed ledger sum of each part and site with its last date; zero balances drop."""
    signed = F.when(F.col("type") == "I", F.col("quantity")).otherwise(-F.col("quantity"))
    return transaction.groupBy("part_id", "site_id").agg(F.sum(signed).alias("net_qty"), F.max("trans_date").cast("string").alias("last_date")).where("net_qty <> 0")


def due_against_stock(part: DataFrame, lines: DataFrame) -> DataFrame:
    """Running open quantity of a part by ship date against what is on hand, and the first row of each part."""
    rows = running_sums(lines.withColumn("_one", F.lit(1)), ["part_id"], ["need_by_date", "order_line_id"], {"_due": "open_qty", "_nth": "_one"})
    rows = rows.join(part.select("part_id", "on_hand_qty"), "part_id")
    return rows.select("order_line_id", "part_id", "open_qty", F.round("_due", 2).alias("running_due"), (F.col("_due") <= F.col("on_hand_qty")).alias("covered"), (F.col("_nth") == 1).alias("first_in_part"))


def trace_rollup(transaction: DataFrame) -> DataFrame:
    """Transactions of a part by kind: ids in order as one text, and sums."""
    rows = transaction.groupBy("part_id", "type").agg(F.array_sort(F.collect_list("transaction_id")).alias("ids"), F.round(F.sum("quantity"), 2).alias("quantity"))
    return rows.select("part_id", "type", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("transaction_ids"), F.size("ids").cast("long").alias("n"), "quantity")


def attributes_to_columns(attributes: DataFrame, names: list[str]) -> DataFrame:
    """Attribute rows (doc, name, value) to one row per doc; of repeated values the greatest counts."""
    return attributes.groupBy("doc").pivot("name", names).agg(F.max("value"))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def split_text(df: DataFrame, column: str) -> DataFrame:
    """White space normalized; the text's first line and its second (null if it has none)."""
    lines = F.split(F.coalesce(F.col(column), F.lit("")), r"\r?\n")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return df.withColumns({"first_line": tidy(F.get(lines, F.lit(0))), "second_line": tidy(F.get(lines, F.lit(1)))})


def work_order_number(df: DataFrame) -> DataFrame:
    """BASE[-SUB]/LOT[.SPLIT], without the parts that are 0."""
    sub = F.when(F.col("sub_id") > 0, F.concat(F.lit("-"), F.col("sub_id"))).otherwise("")
    split = F.when(F.col("split_id") > 0, F.concat(F.lit("."), F.col("split_id"))).otherwise("")
    return df.withColumn("wo_number", F.concat(F.col("base_id"), sub, F.lit("/"), F.col("lot_id"), split))


def open_work_orders(df: DataFrame) -> DataFrame:
    """Work orders in an open status, with their number and the status in words."""
    words = F.when(F.col("status") == "R", "Released").when(F.col("status") == "F", "Firmed").when(F.col("status") == "U", "Unreleased")
    return work_order_number(df).withColumn("status_name", words).where("status_name is not null")


def daily_defects(daily: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    last = daily.agg(F.max("day").alias("as_of")) if as_of is None else daily.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("as_of"))
    rows = daily.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("as_of", days))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("total").alias("produced"), F.sum("defects").alias("defects")).withColumn("defect_rate", F.round(100 * F.col("defects") / F.col("produced"), 4))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, non-null and distinct values, least and greatest as text. Each column is grouped by itself, so that
    a task holds values of one column and no row is multiplied by the number of columns."""

    def profile(c: str) -> DataFrame:
        values = df.select(F.col(c).alias("v"), F.col(c).cast("string").alias("text")).groupBy("v", "text").agg(F.count("*").alias("n"))
        zeros = F.count_if(F.col("text") == "0.0") * F.count_if(F.col("text") == "-0.0") if df.schema[c].dataType.typeName() in ("double", "float") else F.lit(0)
        count = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null")
        return values.agg(count, (F.count("v") - zeros).alias("distinct_values"), F.min("text").alias("least"), F.max("text").alias("greatest")).select(F.lit(c).alias("column_name"), "*")

    return reduce(DataFrame.unionByName, [profile(c) for c in df.columns])


def surrogate_keys(df: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """id and name of distinct names: known ones keep their id, new ones follow the greatest. The running number is
    over distinct names only, dealt by ranges of the name, so no one partition sees all rows."""
    fresh = df.select(F.col(name).alias("name")).where("name is not null").distinct()
    base = 0
    if known is not None:
        fresh = fresh.join(known, "name", "left_anti")
        base = known.agg(F.max("id")).first()[0] or 0
    placed = cut(fresh.repartitionByRange("name").withColumn("part", F.spark_partition_id()))  # written, so that each name keeps its part
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    numbered = placed.withColumn("k", within).join(F.broadcast(before), "part").select((F.col("k") + F.col("before") + base).alias("id"), "name")
    return numbered if known is None else known.select("id", "name").unionByName(numbered)


def email_domain(c, labels: int = 2):
    """Lower-case domain of an address, cut to its last labels."""
    parts = F.split(F.regexp_extract(F.lower(F.trim(c)), r"@([a-z0-9.\-]+)$", 1), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def parse_date(c, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")):
    """The first format that parses; else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def common_tables(usage: DataFrame) -> DataFrame:
    """Pairs of files and how many tables both use. All pairs of a table's files are the report, so it takes tables that
    are used by a bounded number of files, as source files are."""
    a = usage.select("table_name", F.col("file").alias("file_a")).distinct()
    b = usage.select("table_name", F.col("file").alias("file_b")).distinct()
    return a.join(b, "table_name").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("tables"))


def link_vouchers(payable_line: DataFrame, receiving_line: DataFrame) -> DataFrame:
    """Vouchers without a receipt get the first receipt of their purchase line; linked ones stay."""
    first = receiving_line.groupBy("po_line_id").agg(F.min("receipt_line_id").alias("found"))
    return payable_line.join(first, "po_line_id", "left").select("payable_line_id", "po_line_id", F.coalesce("receipt_line_id", "found").alias("receipt_line_id"))


def usage_statistics(usage: DataFrame) -> DataFrame:
    """Per table: uses, distinct files, and its share of all uses."""
    whole = usage.agg(F.count("*").alias("total"))
    return usage.groupBy("table_name").agg(F.count("*").alias("uses"), F.countDistinct("file").alias("files")).crossJoin(F.broadcast(whole)).select("table_name", "uses", "files", F.round(100 * F.col("uses") / F.col("total"), 4).alias("share_pct"))


def mapped_domain(addresses: DataFrame, mapping: DataFrame, column: str = "address") -> DataFrame:
    """Addresses lower-cased and stripped, with the name that a mapping gives their domain, else the domain itself."""
    clean = F.lower(F.trim(F.col(column)))
    rows = addresses.withColumn(column, clean).withColumn("domain", email_domain(F.col(column)))
    return rows.join(mapping.select("domain", F.col("name").alias("_name")).dropDuplicates(["domain"]), "domain", "left").withColumn("organization", F.coalesce("_name", "domain")).drop("_name")
