"""Graph, hierarchy and similarity operators over edge DataFrames (src, dst). Iterations cut their lineage and stop on an
empty frontier; one that meets a bound before raises, as does a cycle in a hierarchy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.keywords import of_first_keyword
from millrace.functions.lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def explode_hierarchy(edges: DataFrame, root, max_depth: int = 50) -> DataFrame:
    """Indented explosion below a root: level, node, parent and the path of row numbers among siblings."""
    numbered = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.row_number().over(Window.partitionBy("src").orderBy("dst")).alias("ordinal"))
    frontier = cut(numbered.where(F.col("parent") == root).select(F.lit(1).alias("level"), "node", "parent", F.col("ordinal").cast("string").alias("path")))
    out = frontier
    for level in range(2, max_depth + 2):
        below = frontier.select(F.col("node").alias("parent"), F.col("path").alias("above"))
        frontier = cut(numbered.join(below, "parent").select(F.lit(level).alias("level"), "node", "parent", F.concat_ws("-", "above", F.col("ordinal").cast("string")).alias("path")))
        if frontier.isEmpty():
            return out
        out = out.union(frontier)
    raise ValueError(f"the hierarchy is deeper than {max_depth} levels or has a cycle")


def where_used(edges: DataFrame, node, max_depth: int | None = None) -> DataFrame:
    """All ancestors of a node with their least distance, by breadth-first frontiers: shared components are met once."""
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = edges.sparkSession.range(1).select(F.lit(node).cast(edges.schema["dst"].dataType).alias("id"))
    return shortest_paths(up, start, max_depth).where("distance > 0").select("node", "distance")


def reference_levels(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Levels of tables by foreign keys (src references dst): roots are referenced and reference nothing; what no root
    reaches is at level -1; of several parents the least counts. Nodes below max_depth, if there is one, raise."""
    roots = edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")
    if roots.isEmpty():
        roots = edges.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(3).select("id")
    seen = cut(roots.select("id", F.lit(0).alias("level"), F.lit(None).cast(edges.schema["dst"].dataType).alias("parent")))
    frontier = seen
    for level in count(1):
        reached = edges.join(frontier.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
        frontier = cut(reached.join(seen, "id", "left_anti").select("id", F.lit(level).alias("level"), "parent"))
        if frontier.isEmpty():
            break
        if max_depth is not None and level > max_depth:
            raise ValueError(f"references are deeper than {max_depth} levels")
        seen = cut(seen.union(frontier))
    return nodes.select("id").distinct().join(seen, "id", "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, within: int | None = None) -> DataFrame:
    """source, node, distance and the least predecessor, for many sources at once by breadth-first frontiers. Nodes
    beyond max_depth, if there is one, raise. within: a question about the nodes at most so many edges away."""
    seen = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast(edges.schema["src"].dataType).alias("via")))
    frontier = seen
    for distance in count(1) if within is None else range(1, within + 1):
        step = edges.join(frontier.select("source", F.col("node").alias("src")), "src").groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        frontier = cut(step.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(distance).alias("distance"), "via"))
        if frontier.isEmpty():
            break
        if max_depth is not None and distance > max_depth:
            raise ValueError(f"paths are longer than {max_depth} edges")
        seen = cut(seen.union(frontier))
    return seen


def path_to(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of a shortest path from each source to each end (source, node), in order, from the predecessors that
    shortest_paths found; a pair that no path joins drops. One join a step, of the ends only."""
    step = paths.select("source", F.col("node").alias("at"), "via")
    walk = cut(ends.select("source", "node").join(paths.select("source", "node"), ["source", "node"], "left_semi").select("source", "node", F.col("node").alias("at"), F.array("node").alias("path")))
    done = None
    while True:
        found = walk.where("at = source")
        done = found if done is None else done.union(found)
        rest = walk.where("at <> source")
        if rest.isEmpty():
            return done.select("source", "node", "path")
        walk = cut(rest.join(step, ["source", "at"]).select("source", "node", F.col("via").alias("at"), F.concat(F.array("via"), "path").alias("path")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degree over nodes - 1, of the undirected graph."""
    both = undirected(edges)
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    n = degree.agg(F.count("*").alias("n"))
    return degree.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"))


def density(edges: DataFrame) -> DataFrame:
    both = undirected(edges)
    return both.agg(F.countDistinct("src").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges")).withColumn("density", F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 8))


def dealt(edges: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The edges dealt by a node and held so on the executors' disks, for iterations: a round then moves a row a node to the
    edges, not the edges. Lost ones are dealt anew from what the edges come from. To be unpersisted after the last round."""
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // most))
    held = edges.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
    held.count()  # only when they are there does a plan know how they are dealt
    return held


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (its least id): least labels of neighbours with pointer jumping, until none moves."""
    both = cut(undirected(edges))
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        after = cut(step.join(labels.select(F.col("id").alias("component"), F.col("component").alias("next")), "component").select("id", "old", F.least("component", "next").alias("component")))
        if after.where("old <> component").isEmpty():
            return after.select("id", "component")
        labels = after.select("id", "component")


def page_rank(edges: DataFrame, rounds: int = 10, change: bool = False) -> DataFrame:
    """A page's rank goes in equal parts to the pages it links to; rank of pages without links is spread over all.
    change: adds avg_change, by how much the last round moved a rank on average. Ranks of a graph in two halves swap
    between them and don't settle."""
    links = dealt(cut(edges.select("src", "dst").distinct()), "src")
    degree = cut(links.groupBy("src").agg(F.count("*").alias("out")))
    nodes = cut(degree.select(F.col("src").alias("id")).union(links.select("dst")).distinct())
    n = nodes.count()
    ranks = before = nodes.select("id", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        gift = degree.join(ranks.withColumnRenamed("id", "src"), "src").select("src", (F.col("rank") / F.col("out")).alias("gift"))
        given = links.join(gift.hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("gift").alias("got"))
        after = cut(nodes.join(given, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got")))
        lost = (n - after.agg(F.sum("got")).first()[0]) / n
        before, ranks = ranks, after.select("id", (F.col("got") + F.lit(lost)).alias("rank"))
    links.unpersist()
    if not change:
        return ranks
    moved = ranks.join(before.withColumnRenamed("rank", "was"), "id").agg(F.avg(F.abs(F.col("rank") - F.col("was"))).alias("avg_change"))
    return ranks.crossJoin(F.broadcast(moved))


def top_node(edges: DataFrame) -> DataFrame:
    """The node of the greatest degree; of equals the least."""
    return degree_centrality(edges).orderBy(F.desc("degree"), "id").limit(1)


def fan_out(joins: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Queries (query, from_table, to_table, cardinality) that join along two or more to-many edges and aggregate over two
    or more tables: their sums count rows more than once."""
    many = joins.where("cardinality in ('1:N', 'N:N')").groupBy("query").agg(F.count("*").alias("to_many"))
    sums = aggregated.groupBy("query").agg(F.countDistinct("table_name").alias("aggregated_tables"))
    return many.join(sums, "query").where("to_many >= 2 and aggregated_tables >= 2")


def bridge_tables(joins: DataFrame) -> DataFrame:
    """Tables that two different tables join to-many: candidates for a bridge between those."""
    many = joins.where("cardinality = '1:N'").select("from_table", "to_table").distinct()
    a, b = many.select(F.col("from_table").alias("left_table"), "to_table"), many.select(F.col("from_table").alias("right_table"), "to_table")
    return a.join(b, "to_table").where("left_table < right_table").select("left_table", "right_table", F.col("to_table").alias("bridge"))


def join_cardinality(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """1:1, N:1, 1:N or N:N of a declared key pair, measured on the data."""
    most = lambda df, key, name: df.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count").alias(name), F.count("*").alias(name + "_keys"))
    rows = most(left, left_key, "l").crossJoin(most(right, right_key, "r"))
    side = lambda c: F.when(F.col(c) > 1, "N").otherwise("1")
    return rows.select(F.lit(left_key).alias("left_key"), F.lit(right_key).alias("right_key"), F.concat_ws(":", side("l"), side("r")).alias("cardinality"), F.col("l_keys").alias("left_keys"), F.col("r_keys").alias("right_keys"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2000) -> DataFrame:
    """The k most similar other vectors of each query (id, v). Queries go to the tasks in blocks of about `block` rows,
    dealt by a hash of the id; a task multiplies slices of its vectors with a block as matrices and keeps the k best of
    each query, so k rows a query and task meet in the end. Vectors without a length have no similarity."""
    vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    queries = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    blocks = max(1, -(-queries.count() // block))
    found = None
    for n in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        best = top_k_of_block(vectors, mine.toArrow(), k)
        best = best if blocks == 1 else cut(best)
        found = best if found is None else found.union(best)
    return found


def unit_rows(v: pa.Array) -> np.ndarray:
    """Rows of equal length 1; rows without a length are nan."""
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.empty((0, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def top_k_of_block(vectors: DataFrame, block: pa.Table, k: int) -> DataFrame:
    block = block.combine_chunks()
    ids, q = block["id"].to_numpy(), unit_rows(block["v"].combine_chunks())
    held = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = held.value
        best_s, best_i = np.full((len(query_ids), 0), np.nan), np.empty((len(query_ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if not len(query_ids):
                    continue
                some = part["id"].to_numpy()
                s = np.round(q @ unit_rows(part["v"]).T, 6) + 0.0
                s[query_ids[:, None] == some[None, :]] = np.nan
                best_s, best_i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(some, s.shape)], 1)
                order = np.lexsort((best_i, np.where(np.isnan(best_s), np.inf, -best_s)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        row, column = np.nonzero(~np.isnan(best_s))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(best_i[row, column]), pa.array(best_s[row, column])], names=["query_id", "id", "similarity"])

    scored = vectors.mapInArrow(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def usage_impact(usage: DataFrame) -> DataFrame:
    """How many files use a table: none, low (< 5), medium (< 10) or high."""
    rows = usage.groupBy("table_name").agg(F.countDistinct("file").alias("files"))
    n = F.col("files")
    return rows.withColumn("impact", F.when(n == 0, "none").when(n < 5, "low").when(n < 10, "medium").otherwise("high"))


def token_anchors(terms: DataFrame, texts: DataFrame, threshold: int = 2, often: int = 1000) -> DataFrame:
    """Best terms of each text by token overlap: 2 for a token of the term, 1 for one of its definition (if terms have
    one), at least the threshold, ties kept. Tokens are distinct within a text.

    Tokens of at most `often` terms join texts with terms. Of the more frequent ones each text and each term has a set; equal
    sets are one, and sets are held against sets, so that a token of all texts and terms makes no pair of each. Terms of a
    set are listed only for texts of which that set alone gives the best score."""
    split = lambda c: F.array_distinct(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{Nd}]+"))
    tokens = lambda df, key, c: df.select(key, F.explode(split(c)).alias("token")).where("token <> ''")
    weighted = tokens(terms, "term_id", "term").withColumn("w", F.lit(2))
    if "definition" in terms.columns:
        weighted = weighted.union(tokens(terms, "term_id", "definition").withColumn("w", F.lit(1)))
    weighted, of_text = weighted.groupBy("term_id", "token").agg(F.sum("w").alias("w")), tokens(texts, "text_id", "text")
    frequent = weighted.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > often).select("token")
    best = Window.partitionBy("text_id")
    if not frequent.limit(1).count():
        score = of_text.join(weighted, "token").groupBy("text_id", "term_id").agg(F.sum("w").alias("score"))
        return score.where(F.col("score") >= threshold).withColumn("top", F.max("score").over(best)).where("score = top").drop("top")
    frequent = cut(frequent)
    rare = of_text.join(frequent, "token", "left_anti").join(weighted, "token").groupBy("text_id", "term_id").agg(F.sum("w").alias("rare"))
    numbered = lambda rows, key, item, name: rows.join(frequent, "token", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn(name, F.sha2(F.to_json("items"), 256))
    term_sets, text_sets = cut(numbered(weighted, "term_id", F.struct("token", "w"), "term_set")), cut(numbered(of_text, "text_id", F.struct("token"), "text_set"))
    items = lambda rows, name: rows.groupBy(name).agg(F.first("items").alias("items")).select(name, F.explode("items").alias("x")).select(name, "x.*")
    pairs = cut(items(text_sets, "text_set").join(items(term_sets, "term_set"), "token").groupBy("text_set", "term_set").agg(F.sum("w").alias("both")))
    found = rare.join(text_sets.select("text_id", "text_set"), "text_id", "left").join(term_sets.select("term_id", "term_set"), "term_id", "left").join(pairs, ["text_set", "term_set"], "left")
    found = found.select("text_id", "term_id", (F.col("rare") + F.coalesce("both", F.lit(0))).alias("score"))
    set_best = pairs.withColumn("top", F.max("both").over(Window.partitionBy("text_set"))).where("both = top").select("text_set", "term_set", F.col("top").alias("score"))
    alone = text_sets.select("text_id", "text_set").join(set_best, "text_set").join(found.groupBy("text_id").agg(F.max("score").alias("by_rare")), "text_id", "left").where("by_rare is null or score >= by_rare")
    listed = alone.join(term_sets.select("term_id", "term_set"), "term_set").select("text_id", "term_id", "score")
    both = found.unionByName(listed).groupBy("text_id", "term_id").agg(F.max("score").alias("score")).where(F.col("score") >= threshold)
    return both.withColumn("top", F.max("score").over(best)).where("score = top").drop("top")


def route_by_keyword(questions: DataFrame, routes: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """The route of the first keyword in order that a question contains, else OUT_OF_SCOPE."""
    return questions.withColumn("route", of_first_keyword(questions.sparkSession, F.lower(F.col(text)), routes, "OUT_OF_SCOPE"))


def node_key(prefix: str, name: Column, most: int = 120) -> Column:
    """Stable key: other characters become _, long names are cut and get a digest."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_\-:.]", "_")
    return F.concat(F.lit(prefix + ":"), F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, 60), F.lit("_"), F.sha1(name))).otherwise(clean))


def ambiguous(fields: DataFrame) -> DataFrame:
    """Fields with more than one concept, and those concepts."""
    return fields.groupBy("field").agg(F.array_sort(F.collect_set("concept")).alias("c")).where(F.size("c") > 1).select("field", F.size("c").alias("n_concepts"), F.array_join("c", ", ").alias("concepts"))
