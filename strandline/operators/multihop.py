"""Neighbours and multi-hop contexts of many starts at once, with the bounds that a single search has.

A start's neighbours are edges in breadth-first order: a node is expanded over its first `per_node` edges by number, in either
direction, and nodes seen first go first. Repeated edges stay. As every node that waits has an edge, no more than `most` of them
per start and hop can matter, so the frontier is cut to that and what is moved is bounded by starts x most x per_node. Each
hop is written, so plans don't grow with depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources import storage

PER_NODE, MOST = 10, 20
#: Letters of a start's text, of a neighbour's, and neighbours shown for a start.
START_CUT, NEIGHBOUR_CUT, CONTENT_CUT, SHOWN = 600, 300, 500, 3
#: Fixed values of the path contexts: letters of a start's text and of an end's, parts of a context per start asked for.
PATH_START_CUT, EVIDENCE_CUT, PARTS = 1800, 1200, 5


def first_edges(edges: DataFrame, per_node: int = PER_NODE) -> DataFrame:
    """edges: src, dst, rel, eid (order of arrival). node, other, n, src, dst, rel: each node's first edges, at either end. The rank's
    limit is pushed before the shuffle, so a hub sends few rows of each task."""
    e = edges.select("src", "dst", "rel", "eid")
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), *e.columns).unionByName(e.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), *e.columns))
    w = Window.partitionBy("node").orderBy("eid")
    return ends.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_node).drop("eid")


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = MOST, per_node: int = PER_NODE) -> DataFrame:
    """starts: start (once each). start, pos (from 1), hop, src, dst, rel: the first `most` edges in breadth-first order."""
    e = storage.cut(first_edges(edges, per_node), "first_edges")
    kind = starts.schema["start"].dataType.simpleString()
    front = starts.select("start", F.col("start").alias("node"), F.array().cast("array<int>").alias("path"))
    seen, out = storage.cut(front.select("start", "node"), "seen"), None
    for hop in range(1, depth + 1):
        found = storage.cut(front.join(e, "node").select("start", "other", F.concat("path", F.array("n")).alias("path"), "src", "dst", "rel"), "hop")
        rows = found.select("start", F.lit(hop).alias("hop"), "path", "src", "dst", "rel")
        out = rows if out is None else out.unionByName(rows)
        if hop == depth:
            break
        new = found.groupBy("start", F.col("other").cast(kind).alias("node")).agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti")
        first = Window.partitionBy("start").orderBy("path")
        front = storage.cut(new.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n"), "front")
        seen = seen.unionByName(front.select("start", "node"))
    order = Window.partitionBy("start").orderBy("hop", "path")
    return out.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("start", "pos", "hop", "src", "dst", "rel")


def with_content(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the text and title of each edge's dst; an end that is no node has empty ones. nodes: id, title, content."""
    n = nodes.select(F.col("id").alias("dst"), F.substring(F.coalesce("content", F.lit("")), 1, CONTENT_CUT).alias("content"), F.coalesce("title", F.lit("")).alias("title"))
    return found.join(n, "dst", "left").withColumns({"content": F.coalesce("content", F.lit("")), "title": F.coalesce("title", F.lit(""))})


def context(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, most: int = 5) -> DataFrame:
    """starts: query_id, rank, id (nodes that a search found). query_id, context: each start with its text, then up to three of its
    neighbours that have text and weren't shown yet. A start that is shown already is left out with its neighbours.

    A query has few starts, so what was shown is a fold over a bounded list."""
    near = with_content(neighbours(edges, starts.select(F.col("id").alias("start")).distinct(), depth, most).where(F.col("pos") <= SHOWN), nodes)
    near = near.groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst", "rel", "title", F.substring("content", 1, NEIGHBOUR_CUT).alias("content")))).alias("near"))
    named = nodes.select("id", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.substring(F.coalesce("content", F.lit("")), 1, START_CUT).alias("content"))
    s = starts.join(named, "id").join(near, "id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "title", "content", F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("near")))).alias("ss"))
    none = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("parts"))

    def show(state: Column, x: Column) -> Column:
        fresh = F.struct(F.array_append(state["seen"], x["title"]).alias("seen"), F.array_append(state["parts"], F.concat(F.lit("  → ["), x["title"], F.lit("] ("), x["rel"], F.lit("):\n  "), x["content"])).alias("parts"))
        return F.when((x["content"] != "") & ~F.array_contains(state["seen"], x["title"]), fresh).otherwise(state)

    def start(state: Column, x: Column) -> Column:
        first = F.struct(F.array_append(state["seen"], x["id"]).alias("seen"), F.array_append(state["parts"], F.concat(F.lit("["), x["title"], F.lit("]\n"), x["content"])).alias("parts"))
        return F.when(F.array_contains(state["seen"], x["id"]), state).otherwise(F.aggregate(x["near"], first, show))

    return s.select("query_id", F.array_join(F.aggregate("ss", none, start)["parts"], "\n\n").alias("context"))


def paths(edges: DataFrame, starts: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """starts: start. start, pos, names, rels, end: paths of one and two edges of either direction that end elsewhere, no edge twice: the
    shorter first, then by edge number; `most` a start. nodes: id, name. A start sends `most` edges of each node on its way."""
    e = storage.cut(first_edges(edges, most + 1).select("node", "other", "rel", "n", "src", "dst"), "first_edges")
    side = lambda k: e.select(*(F.col(c).alias(f"{c}{k}") for c in e.columns))
    one = starts.join(side(1), F.col("start") == F.col("node1")).where("start <> other1")
    short = one.select("start", F.array("other1").alias("via"), F.array("rel1").alias("rels"), F.array("n1").alias("at"))
    back = (F.col("src1") == F.col("src2")) & (F.col("dst1") == F.col("dst2")) & (F.col("rel1") == F.col("rel2"))
    two = one.join(side(2), F.col("other1") == F.col("node2")).where(~back & (F.col("other2") != F.col("start")))
    long = two.select("start", F.array("other1", "other2").alias("via"), F.array("rel1", "rel2").alias("rels"), F.array("n1", "n2").alias("at"))
    order = Window.partitionBy("start").orderBy(F.size("rels"), "at")
    top = storage.cut(short.unionByName(long).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most), "paths")
    stops = top.select("start", "pos", F.posexplode(F.concat(F.array("start"), "via")).alias("k", "id")).join(nodes.select("id", "name"), "id", "left")
    names = stops.groupBy("start", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("name", F.col("id").cast("string")).alias("name")))), lambda x: x["name"]).alias("names"))
    return top.join(names, ["start", "pos"]).select("start", "pos", "names", "rels", F.element_at("via", -1).alias("end"))


def path_key(names: Column, rels: Column) -> Column:
    return F.concat(F.array_join(names, " -> "), F.lit("|"), F.array_join(rels, " -> "))


def path_context(starts: DataFrame, nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """starts: query_id, rank, id. nodes: id, name, kind, summary. query_id, context: each start with its text and its paths with the text
    of their ends, a path's names and relations once a query, `max(1, 5 k)` parts in all."""
    found = paths(edges, starts.select(F.col("id").alias("start")).distinct(), nodes, max(2 * k, 3))
    text = nodes.select("id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("kind", F.lit("Node")).alias("kind"), F.coalesce("summary", F.lit("")).alias("summary"))
    heads = starts.join(text, "id").select("query_id", "rank", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("[Start: "), "name", F.lit("] ("), "kind", F.lit(")\n"), F.substring("summary", 1, PATH_START_CUT)).alias("part"))
    ends = found.join(text.select(F.col("id").alias("end"), "summary"), "end", "left")
    part = F.concat(F.lit("Path: "), F.array_join("names", " -> "), F.lit("\nRelation chain: "), F.array_join("rels", " -> "), F.lit("\nEvidence: "), F.substring(F.coalesce("summary", F.lit("")), 1, EVIDENCE_CUT))
    bodies = starts.join(ends, F.col("id") == F.col("start")).select("query_id", "rank", "pos", path_key(F.col("names"), F.col("rels")).alias("key"), part.alias("part"))
    once = Window.partitionBy("query_id", "key").orderBy("rank", "pos")
    bodies = bodies.withColumn("_n", F.row_number().over(once)).where(F.col("_n") == 1).drop("_n")
    order = Window.partitionBy("query_id").orderBy("rank", "pos")
    rows = heads.unionByName(bodies).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, PARTS * k))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
