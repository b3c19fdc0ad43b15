"""Cleansing, masking and audit operators over any DataFrame."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.keywords import of_first_keyword
from millrace.functions.lineage import cut, release

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Patterns of personal data (fixed values).
PERSONAL = {
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b",
}


#: Words in column names and what is suggested for them, in order (fixed values).
MASK_RULES = [
    (("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "private_key"), "redact"),
    (("ssn", "social_security", "tax_id", "taxid", "ein", "passport", "national_id", "drivers_license", "license_no", "account_number", "account_no", "acct_no", "iban", "routing_number", "routing_no", "card_number", "credit_card", "card_no", "dob", "date_of_birth", "birth_date"), "hash"),
    (("email", "e_mail"), "partial"),
    (("phone", "fax", "mobile", "telephone", "cell_no"), "partial"),
    (("first_name", "last_name", "middle_name", "full_name", "contact_name", "person_name", "given_name", "surname", "maiden_name"), "partial"),
    (("street", "address_line", "addr_line", "address1", "address_1", "home_address", "mailing_address"), "redact"),
]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def normalized(name: str) -> str:
    """Punctuation goes, white space becomes one underscore, letters are lower."""
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name).strip()).lower()


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalized(c) for c in df.columns])


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, " ", " "), r"\s+", " "))


def order_statistics(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact linear percentiles of columns. Distinct values are counted first; they are put in ranges, and only the counts
    of ranges and the few values around the wanted ranks reach the driver."""
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    counts = cut(melted.groupBy("c", "v").agg(F.count("*").alias("n")).repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    sizes: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
    for r in sorted(counts.groupBy("c", "part").agg(F.sum("n").alias("n")).collect()):  # a row a range, and a range more a column
        sizes[r.c].append((r.part, r.n))
    wanted: list[tuple[str, int, int, int]] = []
    total = {c: sum(n for _, n in mine) for c, mine in sizes.items()}
    for c, mine in sizes.items():
        before = 0
        ranks = {int(f(s * (total[c] - 1))) for s in shares for f in (math.floor, math.ceil)} if total[c] else set()
        for part, n in mine:
            wanted += [(c, part, r, r - before) for r in ranks if before <= r < before + n]
            before += n
    found: dict[tuple[str, int], float] = {}
    if wanted:  # one job for all ranks, over the ranges that hold one
        at = df.sparkSession.createDataFrame(wanted, "c string, part int, rank long, inside long")
        below = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        held = counts.join(F.broadcast(at.select("c", "part").distinct()), ["c", "part"], "left_semi").withColumn("upto", F.sum("n").over(below))
        rows = held.join(F.broadcast(at), ["c", "part"]).where("upto > inside").groupBy("c", "rank").agg(F.min("v").alias("v"))
        found = {(r.c, r["rank"]): r.v for r in rows.collect()}
    release(counts)

    def value(c: str, s: float) -> float | None:
        if not total[c]:
            return None
        f = s * (total[c] - 1)
        low, high = found[c, math.floor(f)], found[c, math.ceil(f)]
        return low + (f - math.floor(f)) * (high - low)

    return {c: [value(c, s) for s in shares] for c in columns}


def cleanse(df: DataFrame) -> DataFrame:
    """Text is tidied, null text becomes 'Unknown', null numbers the exact median of their column; duplicates go."""
    numbers, texts = numeric_columns(df), text_columns(df)
    out = df.withColumns({c: tidy(quoted(c)) for c in texts}) if texts else df
    if numbers:
        medians = order_statistics(df, numbers, [0.5])
        out = out.withColumns({c: F.coalesce(quoted(c), F.lit(medians[c][0]).cast(df.schema[c].dataType)) for c in numbers})
    if texts:
        out = out.withColumns({c: F.coalesce(quoted(c), F.lit("Unknown")) for c in texts})
    return out.dropDuplicates()


def cleansing_report(df: DataFrame) -> DataFrame:
    """One row per metric: rows, distinct rows and nulls by column, in one pass but for the distinct count."""
    spark = df.sparkSession
    nulls = df.agg(F.count("*").alias("rows"), *[F.count_if(quoted(c).isNull()).alias(f"nulls:{c}") for c in df.columns])
    melted = nulls.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in nulls.columns]), F.array(*[quoted(c) for c in nulls.columns]))).alias("metric", "value"))
    return melted.unionByName(df.distinct().agg(F.count("*").alias("value")).select(F.lit("distinct_rows").alias("metric"), "value")) if spark else melted


def outliers(df: DataFrame, columns: list[str] | None = None, k: float = 3.0) -> DataFrame:
    """Values beyond k interquartile ranges, by exact linear percentiles."""
    columns = columns or numeric_columns(df)
    cuts = order_statistics(df, columns, [0.25, 0.75])
    rows = df.select(*[quoted(c).cast("double").alias(c) for c in columns])

    def far(c: str) -> Column:
        low, high = cuts[c]
        return F.lit(False) if low is None else (quoted(c) < low - k * (high - low)) | (quoted(c) > high + k * (high - low))

    counts = rows.agg(*[F.count_if(far(c)).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[quoted(c) for c in columns]))).alias("column_name", "outliers"))


def coerce(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts by schema; what doesn't parse becomes null; columns whose names look like ids stay text."""
    keep = lambda c: re.search(r"(^|_)(id|code|no|number)$", c, re.I)
    return df.withColumns({c: quoted(c).cast("string") if keep(c) else F.expr(f"try_cast(`{c}` as {kind})") for c, kind in kinds.items()})


def subset(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    kept = [c for c in wanted if c in df.columns]
    return df.select(*[quoted(c) for c in kept]), {"kept": kept, "dropped": [c for c in df.columns if c not in wanted], "missing": [c for c in wanted if c not in df.columns]}


def hash_mask(c: Column, salt: str, length: int = 16) -> Column:
    """Upper hex SHA-256 of value + salt, cut; null and empty values pass."""
    if not salt:
        raise ValueError("masking needs a salt")
    return F.when(c.isNull() | (c == ""), c).otherwise(F.substring(F.upper(F.sha2(F.concat(c, F.lit(salt)), 256)), 1, length))


def mask(c: Column, mode: int, salt: str, length: int = 16) -> Column:
    """Modes: 2 null, 3 hex-prefixed hash, any other hash."""
    if mode == 2:
        return F.lit(None).cast("string")
    hashed = hash_mask(c, salt, length)
    return F.when(c.isNull() | (c == ""), c).otherwise(F.concat(F.lit("0x"), hashed)) if mode == 3 else hashed


def apply_policy(df: DataFrame, table: str, policy: list[dict], salt: str) -> DataFrame:
    """Masks the columns of active policy rows of this table; a row needs a column that exists."""
    rules = [p for p in policy if p["status"] == "active" and p["table_name"] == table and p["column_name"] in df.columns]
    return df.withColumns({p["column_name"]: mask(quoted(p["column_name"]).cast("string"), p["masking_mode"], salt, p.get("field_length") or 16) for p in rules}) if rules else df


def masked_extract(df: DataFrame, table: str, policy: list[dict], salt: str) -> DataFrame:
    """Long form: one row per value of a masked column."""
    rules = [p for p in policy if p["status"] == "active" and p["table_name"] == table and p["column_name"] in df.columns]
    values = F.array(*[F.struct(F.lit(p["column_name"]).alias("column_name"), F.lit(p["masking_mode"]).alias("masking_mode"), mask(quoted(p["column_name"]).cast("string"), p["masking_mode"], salt, p.get("field_length") or 16).alias("masked_value")) for p in rules])
    return df.select(F.explode(values).alias("v")).select(F.lit(table).alias("table_name"), "v.*")


def personal_counts(text: str) -> dict[str, Column]:
    return {k: F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)) for k, p in PERSONAL.items()}


def suggested_masks(columns: DataFrame, name: str = "column_name") -> DataFrame:
    """A masking strategy for each column of a catalog by keywords of its name, the first rule that fits; else none."""
    values = [(word, strategy) for words, strategy in MASK_RULES for word in words]
    return columns.withColumn("masking_strategy", of_first_keyword(columns.sparkSession, F.lower(F.col(name)), values, "none"))


def mask_coverage(suggested: DataFrame, policy: DataFrame) -> DataFrame:
    """By suggested strategy: columns, and how many of them an active policy row covers."""
    active = policy.where("status = 'active'").select("table_name", "column_name", F.lit(1).alias("covered")).distinct()
    return suggested.join(active, ["table_name", "column_name"], "left").groupBy("masking_strategy").agg(F.count("*").alias("columns"), F.count("covered").alias("covered"))


def subset_report(df: DataFrame, wanted: list[str]) -> DataFrame:
    """What subset() keeps, drops and misses, as rows, with the values that each column has; one pass over the data."""
    _, report = subset(df, wanted)
    rows = [F.struct(F.lit(state).alias("state"), F.lit(c).alias("column_name"), (F.lit(0).cast("long") if state == "missing" else F.count(quoted(c))).alias("n_values")) for state, names in report.items() for c in names]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def ingest_status(text: str) -> Column:
    hits = sum(personal_counts(text).values(), F.lit(0))
    return F.when(hits > 0, "blocked_pii").otherwise("ingested")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of personal data by kind, and whether they block the document."""
    return docs.select("doc_id", *[c.alias(k) for k, c in personal_counts(text).items()], ingest_status(text).alias("status"))


def corpus_manifest(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), ingest_status(text).alias("status"))


def audit(df: DataFrame, unique: list[str] = (), not_null: list[str] = (), predicates: dict[str, str] | None = None) -> DataFrame:
    """One row per rule with its number of violations."""
    counts = [F.count_if(quoted(c).isNull()).alias(f"not_null:{c}") for c in not_null] + [F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(f"predicate:{n}") for n, p in (predicates or {}).items()]
    parts = []
    if counts:
        wide = df.agg(*counts)
        parts.append(wide.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in wide.columns]), F.array(*[quoted(c) for c in wide.columns]))).alias("rule", "violations")))
    for c in unique:
        parts.append(df.where(quoted(c).isNotNull()).groupBy(quoted(c)).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(f"unique:{c}").alias("rule"), "violations"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def upsert(target: DataFrame, source: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of the source replace those of the target with the same key; of repeated source keys the newest row wins."""
    first = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last())
    rows = source.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return target.join(source.select(*key).distinct(), key, "left_anti").unionByName(rows)


def changes(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Key and _action (INSERT, UPDATE, UNCHANGED, DELETE) by a null-safe comparison of all other columns."""
    rest = [c for c in target.columns if c not in key]
    image = lambda df, name: df.select(*key, F.struct(*rest).alias(name))
    both = image(target, "old").join(image(source, "new"), key, "full")
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("UPDATE")
    return both.select(*key, action.alias("_action"))


def parity(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Counts of rows that are missing, extra, different or the same between two copies."""
    names = F.create_map(*[F.lit(x) for x in ("INSERT", "extra", "DELETE", "missing", "UPDATE", "different", "UNCHANGED", "same")])
    return changes(left, right, key).groupBy(names[F.col("_action")].alias("state")).agg(F.count("*").alias("n"))
