"""Property graph: nodes(id, labels, ...) and edges(src, dst, rel) as DataFrames; upserts, traversal, paths, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources import storage


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: a, b, rel, eid, forward."""
    e = edges if "eid" in edges.columns else edges.withColumn("eid", F.xxhash64("src", "dst", "rel"))
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel", "eid", F.lit(True).alias("forward"))
    return out.unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", "eid", F.lit(False).alias("forward")))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, order: str, keep_if_null: tuple = ("title",)) -> DataFrame:
    """MERGE: new rows replace old ones of their key, the last of several wins; columns of keep_if_null keep the old
    value where the new one is null."""
    rest = [c for c in old.columns if c != key]
    last = new.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_new"))
    j = old.withColumn("_old", F.struct(*rest)).select(key, "_old").join(last, key, "full")
    value = lambda c: F.coalesce(F.col("_new")[c], F.col("_old")[c]) if c in keep_if_null else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])
    return j.select(key, *[value(c).alias(c) for c in rest])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """New edges whose ends exist, once per (src, dst, rel); old ones win."""
    n = nodes.select(F.col(node).alias("_id")).distinct()
    ok = new.join(n, new["src"] == n["_id"], "left_semi").join(n, new["dst"] == n["_id"], "left_semi")
    fresh = ok.dropDuplicates(["src", "dst", "rel"]).join(old.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Every node with its number of edges at either end, 0 without one."""
    d = edges.select(F.col("src").alias(node)).unionAll(edges.select(F.col("dst").alias(node))).groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, node, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


#: Items of a group that are paired as a list; larger groups are dealt over blocks of so many.
LIST = 64


def cliques(items: DataFrame, group: str, item: str, rel: Column | str, most: int = LIST) -> DataFrame:
    """Edges between the items of a group, smaller first. A group of more than `most` items is dealt over blocks by hash, and every two
    blocks meet in a task of their own, so no task has more than most x most pairs."""
    few = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item).distinct()
    sizes = few.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") > most)
    g = few.join(large, group, "left_anti").groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("xs"))  # `most` items at most
    a = g.select(group, "xs", F.posexplode("xs").alias("i", "src"))
    rest = F.slice("xs", F.col("i") + 2, F.greatest(F.size("xs") - F.col("i") - 1, F.lit(0)))
    out = a.select(group, "src", F.explode(rest).alias("dst"))
    n = F.ceil(F.col("_size") / most).cast("int")
    dealt = few.join(large, group).withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_n")).cast("int"))
    left = dealt.select(group, F.col(item).alias("_x"), F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_j"))
    right = dealt.select(group, F.col(item).alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    pairs = left.join(right, [group, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    out = out.unionByName(pairs.select(group, F.least("_x", "_y").alias("src"), F.greatest("_x", "_y").alias("dst")))
    return out.withColumn("rel", F.lit(rel) if isinstance(rel, str) else rel)


def bfs(edges: DataFrame, start: DataFrame, depth: int, per_node: int | None = None) -> DataFrame:
    """start: start, node. start, node, hop: nodes reached over edges of either direction, by the fewest hops. With
    per_node, each node is expanded over so many edges at most, by edge order. Each hop is written, so plans don't grow with depth."""
    e = both_ways(edges)
    if per_node:
        e = e.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("eid", "forward"))).where(F.col("_n") <= per_node)
    e = e.select("a", "b").distinct()
    seen = start.select("start", "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        new = front.join(e, front["node"] == e["a"]).select("start", F.col("b").alias("node")).distinct()
        front = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(k))
        front = storage.cut(front, "front") if k < depth else front
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, start: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """start: start. Paths of one and two edges of either direction that end elsewhere; no edge twice in a path:
    start, mid, end, rels, hops, path."""
    e = both_ways(edges)
    if without is not None:
        e = e.join(without.select(F.col("id").alias("b")), "b", "left_anti")
    one = start.join(e, start["start"] == e["a"]).where("start <> b").select("start", F.lit(None).cast(start.schema["start"].dataType).alias("mid"), F.col("b").alias("end"), F.array("rel").alias("rels"), F.lit(1).alias("hops"), F.array("eid").alias("eids"))
    first = start.join(e, start["start"] == e["a"]).select("start", F.col("b").alias("mid"), F.col("rel").alias("r1"), F.col("eid").alias("e1"))
    two = first.join(e, first["mid"] == e["a"]).where("e1 <> eid and start <> b").select("start", "mid", F.col("b").alias("end"), F.array("r1", "rel").alias("rels"), F.lit(2).alias("hops"), F.array("e1", "eid").alias("eids"))
    return one.unionByName(two)


def semantic_paths(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """mentions: article, concept, score. Each article with its best score and its distinct `concept -rel-> other`
    strings; a concept without relations gives no string, and the article stays."""
    r = both_ways(relations)
    j = mentions.join(r, mentions["concept"] == r["a"], "left")
    path = F.concat(F.col("concept").cast("string"), F.lit(" -"), F.col("rel"), F.lit("-> "), F.col("b").cast("string"))
    return j.groupBy("article").agg(F.max("score").alias("score"), F.sort_array(F.collect_set(path)).alias("paths"))


def regex_triples(df: DataFrame, doc_id: str, column: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """rules: (subject type, predicate, object type, pattern of two groups). doc_id, subject, predicate, object and
    types, of every match whose ends differ."""
    out = None
    for st, pred, ot, pattern in rules:
        p = F.lit("(?iuU)" + pattern)
        a, b = F.regexp_extract_all(F.col(column), p, F.lit(1)), F.regexp_extract_all(F.col(column), p, F.lit(2))
        t = df.select(doc_id, F.explode(F.arrays_zip(a.alias("s"), b.alias("o"))).alias("x"))
        t = t.select(doc_id, F.trim("x.s").alias("subject"), F.lit(st).alias("subject_type"), F.lit(pred).alias("predicate"), F.trim("x.o").alias("object"), F.lit(ot).alias("object_type")).where("subject <> object")
        out = t if out is None else out.unionByName(t)
    return out


def near_pairs(a: DataFrame, b: DataFrame, doc: str, pos_a: str, pos_b: str, width: int) -> DataFrame:
    """Band join inside documents: |pos_a - pos_b| < width. Positions fall into bands of the width, so the join is by
    document and band, and only neighbours meet."""
    x = a.withColumn("_band", F.explode(F.array(*[F.floor(F.col(pos_a) / width) + k for k in (-1, 0, 1)])))
    y = b.withColumn("_band", F.floor(F.col(pos_b) / width))
    return x.join(y, [doc, "_band"]).where(F.abs(F.col(pos_a) - F.col(pos_b)) < width).drop("_band")


def integrity(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """One row of checks: ids are unique and not null, edges are unique, their ends exist."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), (F.count(node) == F.countDistinct(node)).alias("ids_unique"), (F.count(node) == F.count(F.lit(1))).alias("ids_set"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), (F.count(F.lit(1)) == F.count_distinct(F.struct("src", "dst", "rel"))).alias("edges_unique"))
    ids = nodes.select(F.col(node).alias("_id"))
    loose = edges.join(ids, edges["src"] == ids["_id"], "left_anti").unionByName(edges.join(ids, edges["dst"] == ids["_id"], "left_anti")).agg((F.count(F.lit(1)) == 0).alias("ends_exist"))
    return n.join(F.broadcast(e)).join(F.broadcast(loose)).withColumn("passed", F.col("ids_unique") & F.col("ids_set") & F.col("edges_unique") & F.col("ends_exist"))  # one row each
