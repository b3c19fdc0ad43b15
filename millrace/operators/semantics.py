"""Semantic operators: metric templates, intents and concepts over fields, glossaries, tagging and related-document search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cosine_top_k

EM_DASH, STAR = "—", "★"


def metric(df: DataFrame, formula: str, bindings: dict[str, str]) -> Column:
    """The column of a formula whose {variables} are bound to columns. A variable without a binding, a binding without a
    variable, and a binding that names no column (a constant, say) raise."""
    wanted = set(re.findall(r"\{(\w+)\}", formula))
    if missing := wanted - bindings.keys():
        raise ValueError(f"no binding for {sorted(missing)}")
    if extra := bindings.keys() - wanted:
        raise ValueError(f"bindings for nothing: {sorted(extra)}")
    if static := sorted(v for v in bindings.values() if v not in df.columns):
        raise ValueError(f"not columns: {static}")
    return F.expr(re.sub(r"\{(\w+)\}", lambda m: f"`{bindings[m[1]]}`", formula))


def joined_by_keys(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """Tables joined along declared foreign keys (table, column, referenced table, referenced column), in order; columns
    are named table_column. A key whose tables aren't reached yet raises."""
    named = {name: df.select(*[F.col(f"`{c}`").alias(f"{name}_{c}") for c in df.columns]) for name, df in tables.items()}
    start = keys[0][0] if keys else next(iter(named))
    out, seen = named[start], {start}
    for a, ca, b, cb in keys:
        if (a in seen) == (b in seen):
            raise ValueError(f"{a} to {b} doesn't add a table")
        new = b if a in seen else a
        out = out.join(named[new], F.col(f"{a}_{ca}") == F.col(f"{b}_{cb}"))
        seen.add(new)
    return out


def intent_scores(field_set: DataFrame, concept_field: DataFrame, intent_concept: DataFrame, intent_perspective: DataFrame, perspective_concept: DataFrame) -> DataFrame:
    """For each set of fields (set_id, table_name, field_name) the confidence of each intent: the share of its fields that
    the intent resolves, times the mean weight of the concepts; only edges of weight 1 resolve."""
    fields = field_set.distinct()
    total = fields.groupBy("set_id").agg(F.count("*").alias("total"))
    path = intent_concept.where("weight = 1").join(intent_perspective.where("weight = 1").select("intent", "perspective"), "intent").join(perspective_concept, ["perspective", "concept"])
    resolves = path.join(concept_field, "concept").groupBy("intent", "table_name", "field_name").agg(F.max("weight").alias("weight"))
    matched = fields.join(resolves, ["table_name", "field_name"]).groupBy("set_id", "intent").agg(F.count("*").alias("matched"), F.avg("weight").alias("w"))
    return matched.join(total, "set_id").select("set_id", "intent", "matched", F.round(F.col("matched") / F.col("total") * F.col("w"), 3).alias("confidence"))


def elevated_fields(perspective_edge: DataFrame, concept_field: DataFrame, perspective: str | None = None) -> DataFrame:
    """Fields that can mean a concept which a perspective elevates (or uses as its definition with weight 1), with the
    concept's priority."""
    edges = perspective_edge.where("relationship = 'ELEVATES' or (relationship = 'USES_DEFINITION' and weight = 1)")
    edges = edges if perspective is None else edges.where(F.col("perspective") == perspective)
    return edges.select("perspective", "concept", "priority").distinct().join(concept_field, "concept").select("perspective", "concept", "table_name", "field_name", "priority")


def coverage_gaps(edge: DataFrame, binding: DataFrame) -> DataFrame:
    """Edges whose concept has no approved binding."""
    return edge.join(binding.where("status = 'approved'").select("concept").distinct(), "concept", "left_anti")


def undescribed(fields: DataFrame) -> DataFrame:
    """Per table: fields, and those without a description."""
    return fields.groupBy("table_name").agg(F.count("*").alias("fields"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) == "").alias("undescribed"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-|-$", "")


def glossary(lines: DataFrame) -> DataFrame:
    """Terms of lines (doc_id, line_no, value) `term (ACRONYM) ★ — definition`. A head has at most 80 characters and no full
    stop at its end; of equal slugs of a document the first line counts."""
    at = F.instr("value", f" {EM_DASH} ")
    rows = lines.where(at > 0).select("doc_id", "line_no", F.trim(F.substring("value", F.lit(1), at - 1)).alias("head"), F.trim(F.substring("value", at + 3, F.length("value"))).alias("definition"))
    rows = rows.where((F.length("head") <= 80) & ~F.col("head").endswith(".") & (F.col("definition") != ""))
    rows = rows.withColumn("foundational", F.col("head").contains(STAR)).withColumn("head", F.trim(F.replace("head", F.lit(STAR), F.lit(""))))
    acronym = F.trim(F.regexp_extract("head", r"\(([^)]+)\)\s*$", 1))
    rows = rows.select("doc_id", "line_no", F.trim(F.regexp_replace("head", r"\(([^)]+)\)\s*$", "")).alias("term"), acronym.alias("acronym"), "foundational", "definition").withColumn("slug", slug(F.col("term"))).where("slug <> ''")
    first = Window.partitionBy("doc_id", "slug").orderBy("line_no")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "line_no")


def tagged(docs: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """Acronyms of a dictionary (acronym, full_name, domain) that stand in a text as words of 2 to 6 capitals, with their
    expansion. Each text's distinct words go through one join, with the dictionary as the small side if Spark sees it is."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b([A-Z]{2,6})\b"), 1))).alias("acronym"))
    return words.join(dictionary.select("acronym", "full_name", "domain"), "acronym").select("doc_id", "acronym", "full_name", "domain")


def graph_search(vectors: DataFrame, queries: DataFrame, docs: DataFrame, entities: list[str], k: int = 5, related: int = 3) -> DataFrame:
    """Of each query the 2k nearest documents by cosine, the best k of them with up to `related` others that share an entity
    (a keyword in the text, lower-cased): entities in order, then the least ids. Of an entity only its `related` + 1 least
    documents can be among those, so a frequent entity costs no more than a rare one."""
    nearest = cosine_top_k(vectors, queries, 2 * k)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = F.filter(F.array(*[F.when(low.contains(e), F.lit(n)) for n, e in enumerate(entities)]), lambda x: x.isNotNull())
    of_doc = docs.select("doc_id", F.explode(found).alias("entity"))
    least = Window.partitionBy("entity").orderBy("doc_id")
    heads = of_doc.withColumn("n", F.row_number().over(least)).where(F.col("n") <= related + 1).select("entity", F.col("doc_id").alias("other"))
    others = of_doc.join(heads, "entity").where("other <> doc_id").groupBy("doc_id", "other").agg(F.min("entity").alias("entity"))
    listed = others.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("entity", "other"))).where(F.col("n") <= related).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "other"))), lambda x: x["other"].cast("string")), ",").alias("related_docs"))
    return nearest.where(F.col("rank") <= k).join(listed.withColumnRenamed("doc_id", "id"), "id", "left").select("query_id", "id", "similarity", "rank", F.coalesce("related_docs", F.lit("")).alias("related_docs"))
