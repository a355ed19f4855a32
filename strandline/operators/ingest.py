"""Ingest of documents, articles and semantic triples into property-graph tables, with the funnel of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.sources import storage

#: Labels and relations that the graph allows, in their order; the name that stands for the article itself.
LABELS = ("LEGAL_CONCEPT", "ACTOR", "AUTHORITY", "RIGHT", "OBLIGATION", "CONDITION", "PROCEDURE", "PENALTY")
RELATIONS = (
    "REGULATES", "GOVERNS", "APPLIES_TO", "OBLIGATES", "PERMITS", "PROHIBITS", "REQUIRES", "HAS_CONDITION", "HAS_EXCEPTION", "ELIGIBLE_FOR", "NOT_ELIGIBLE_FOR", "RESPONSIBLE_FOR",
    "AUTHORIZES", "SUPERVISES", "ENFORCES", "ISSUED_BY", "GUIDED_BY", "IMPLEMENTS", "REFERS_TO", "AMENDS", "REPLACES", "ABOLISHES", "PART_OF_PROCEDURE", "NEXT_STEP", "RELATED_CONCEPT",
)
ARTICLE, ITSELF = "LegalArticle", "article_node"
#: Least confidence, letters of an article's content, letters that an article must have, fields that a row must have.
CONFIDENT, CONTENT_CUT, LEAST, FIELDS = 0.75, 8000, 20, 5
TRIPLE = "struct<subject_label:string,subject_name:string,relation:string,object_label:string,object_name:string,confidence:double>"


def complete_rows(response: Column) -> Column:
    """The whole rows, as JSON texts, of the first two-dimensional list in a model's answer, however it breaks off.

    A fold over the characters: depth of brackets, whether within a string or after a backslash, where the row began. Brackets in
    strings count for nothing; a row is whole when its own bracket closes."""
    chars = F.split(response, "")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<struct<at:int,size:int>>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        live = ~s["over"] & (s["depth"] > 0)
        quote = live & (c == '"') & ~s["escaped"]
        opens = ~s["over"] & ~s["quoted"] & (c.isin("[", "{") & (s["depth"] > 0) | (c == "["))
        closes = live & ~s["quoted"] & c.isin("]", "}")
        whole = closes & (s["depth"] == 2)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(
            (s["i"] + 1).alias("i"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (live & s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            F.when(opens & (s["depth"] == 1), s["i"]).otherwise(s["at"]).alias("at"), (s["over"] | closes & (s["depth"] == 1)).alias("over"),
            F.when(whole, F.array_append(s["found"], F.struct(s["at"].alias("at"), (s["i"] - s["at"] + 1).alias("size")))).otherwise(s["found"]).alias("found"),
        )

    found = F.aggregate(F.filter(chars, lambda c: c != ""), start, step)["found"]
    return F.transform(found, lambda x: F.substr(response, x["at"] + 1, x["size"]))


def triples(df: DataFrame, response: str) -> DataFrame:
    """df without the response, one row for each triple in it: rows of five fields or more (a sixth is the confidence, 1 where it is
    none), and objects with the fields' names (no confidence: 1, an unreadable one: 0). Longer lists and other things are left out."""
    row = df.withColumn("_row", F.explode(complete_rows(F.coalesce(F.col(response), F.lit(""))))).drop(response)
    cells = F.from_json("_row", "array<string>")
    listed = F.struct(*(F.get(cells, k).alias(n) for k, n in enumerate(("subject_label", "subject_name", "relation", "object_label", "object_name"))), F.coalesce(F.get(cells, 5).try_cast("double"), F.lit(1.0)).alias("confidence"))
    o = F.from_json("_row", "subject_label string, subject_name string, relation string, object_label string, object_name string, confidence string")
    named = F.struct(*(o[n].alias(n) for n in ("subject_label", "subject_name", "relation", "object_label", "object_name")), F.when(o["confidence"].isNull(), 1.0).otherwise(F.coalesce(o["confidence"].try_cast("double"), F.lit(0.0))).alias("confidence"))
    is_list = F.startswith(F.col("_row"), F.lit("["))
    t = F.when(is_list & (F.coalesce(F.size(cells), F.lit(0)) >= FIELDS), listed).when(~is_list & o.isNotNull(), named)
    return row.withColumn("_t", t).where("_t is not null").select(*(c for c in row.columns if c != "_row"), "_t.*")


def canonical(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, in lower case, white space as one space; an alias gives way to its name."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), low), low) if aliases else low


def confident(df: DataFrame, least: float = CONFIDENT) -> DataFrame:
    return df.where(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= least)


def structural(chunks: DataFrame, order: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks: canonical_id, has_canonical_id, law_number, article_number, title, content, order. Documents, articles and HAS_ARTICLE edges
    of the chunks that have an id and 20 letters or more. Of an article's chunks the last counts; a missing title doesn't
    replace one that is there."""
    c = chunks.withColumn("content", F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", "")).where(F.coalesce("has_canonical_id", F.lit(False)) & (F.length("content") >= LEAST))
    docs = c.select(F.col("law_number").alias("doc_id")).distinct().withColumn("source", F.lit(source))
    last = F.max_by(F.struct("law_number", "article_number", "content"), order)
    a = c.groupBy(F.col("canonical_id").alias("article_id")).agg(last.alias("x"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col(order))).alias("title"))
    articles = a.select("article_id", F.col("x.law_number").alias("law_id"), "x.article_number", "title", F.substring("x.content", 1, CONTENT_CUT).alias("content"), F.lit(source).alias("source"))
    edges = c.select(F.col("law_number").alias("src"), F.col("canonical_id").alias("dst"), F.lit("HAS_ARTICLE").alias("rel")).distinct()
    return docs, articles, edges


def allowed(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Triples that the graph takes, with canonical names and the raw ones: known labels and relation, both names there, no article as object."""
    x = df.withColumns({"raw_subject": F.col("subject_name"), "raw_object": F.col("object_name"), "subject_name": canonical(F.col("subject_name"), aliases), "object_name": canonical(F.col("object_name"), aliases), "relation": F.upper(F.trim(F.coalesce("relation", F.lit(""))))})
    return x.where(F.col("subject_label").isin(*LABELS, ARTICLE) & F.col("object_label").isin(*LABELS) & F.col("relation").isin(*RELATIONS) & (F.col("subject_name") != "") & (F.col("object_name") != ""))


def semantic(df: DataFrame, articles: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """df: allowed triples with article_id and an order; articles: article_id. Nodes (label, name, alias: the raw name that came first)
    and edges (src_label, src, rel, dst_label, dst, confidence: the last one's; null for MENTIONS). A triple of the article itself
    starts at its article and is nothing without it; every other one is mentioned by its article at both ends."""
    known = articles.select("article_id").distinct().withColumn("_there", F.lit(True))
    x = df.join(known, "article_id", "left").withColumn("_own", (F.col("subject_label") == ARTICLE) & (F.col("subject_name") == ITSELF)).where(~F.col("_own") | F.col("_there"))
    there = x.where("_there")
    named = lambda d, side: d.select(F.col(f"{side}_label").alias("label"), F.col(f"{side}_name").alias("name"), F.col(f"raw_{side}").alias("raw"), order)
    nodes = named(x.where(~F.col("_own")), "subject").unionByName(named(x, "object")).groupBy("label", "name").agg(F.min_by("raw", F.struct(order, "raw")).alias("alias"))
    ends = x.select(F.when(F.col("_own"), ARTICLE).otherwise(F.col("subject_label")).alias("src_label"), F.when(F.col("_own"), F.col("article_id")).otherwise(F.col("subject_name")).alias("src"), F.col("relation").alias("rel"), F.col("object_label").alias("dst_label"), F.col("object_name").alias("dst"), "confidence", order)
    rels = ends.groupBy("src_label", "src", "rel", "dst_label", "dst").agg(F.max_by("confidence", F.struct(order, "confidence")).alias("confidence"))
    said = lambda d, side: d.select(F.lit(ARTICLE).alias("src_label"), F.col("article_id").alias("src"), F.lit("MENTIONS").alias("rel"), F.col(f"{side}_label").alias("dst_label"), F.col(f"{side}_name").alias("dst"))
    mentions = said(there, "object").unionByName(said(there.where(~F.col("_own")), "subject")).distinct().withColumn("confidence", F.lit(None).cast("double"))
    return nodes, rels.unionByName(mentions)


def observed_write(df: DataFrame, path: str, least: float = CONFIDENT) -> dict[str, int]:
    """Writes the triples that are confident enough, and returns what was counted in the same pass: generated, kept, filtered, and of the
    kept ones each relation and each label's ends."""
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= least
    seen, left = Observation(), Observation()
    counts = [F.count_if(F.col("relation") == r).alias(f"rel:{r}") for r in RELATIONS]
    counts += [(F.count_if(F.col("subject_label") == x) + F.count_if(F.col("object_label") == x)).alias(f"label:{x}") for x in LABELS]
    all_rows = df.observe(seen, F.count(F.lit(1)).alias("generated"), F.count_if(sure).alias("kept"), F.count_if(~sure).alias("filtered"))
    all_rows.where(sure).observe(left, *counts).write.mode("overwrite").parquet(path)
    return seen.get | left.get


def pilot_reports(df: DataFrame, articles: DataFrame, order: str, path: str, samples: int = 20, top: int = 50) -> dict[str, DataFrame]:
    """Writes the kept triples and gives the seven reports: pilot_report (name, n), top_relations, top_concepts (by degree), top_actors,
    semantic_audit_samples, semantic_label_distribution, retrieval_readiness_samples. The funnel and the relations come from the
    pass that writes; samples are in seeded order."""
    spark = df.sparkSession
    counted = observed_write(df, path)
    kept = spark.read.schema(df.schema).parquet(path)
    nodes, edges = semantic(allowed(kept), articles, order)
    nodes, edges = storage.cut(nodes, "nodes"), storage.cut(edges, "edges")
    per = lambda label: F.count_distinct(F.when(F.col("label") == label, F.col("name")))
    ends = kept.select(F.col("subject_label").alias("label"), canonical(F.col("subject_name")).alias("name")).unionByName(kept.select(F.col("object_label").alias("label"), canonical(F.col("object_name")).alias("name")))
    unique = ends.agg(per("LEGAL_CONCEPT").alias("unique_concepts"), per("ACTOR").alias("unique_actors"), per("RIGHT").alias("unique_rights"), per("OBLIGATION").alias("unique_obligations"), per("CONDITION").alias("unique_conditions")).first().asDict()
    funnel = {f"triples_{k}": counted[k] for k in ("generated", "kept", "filtered")} | unique
    relations = [(r, counted[f"rel:{r}"]) for r in RELATIONS if counted[f"rel:{r}"]]
    degree = edges.select(F.col("src_label").alias("label"), F.col("src").alias("name")).unionAll(edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("name"))).where("label = 'LEGAL_CONCEPT'").groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    actors = ends.where("label = 'ACTOR'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    seeded = F.xxhash64(F.lit(7), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(kept.columns)))
    return {
        "pilot_report": spark.createDataFrame(list(funnel.items()), "name string, n long"),
        "top_relations": spark.createDataFrame(relations, "relation string, n long").orderBy(F.desc("n"), "relation"),
        "top_concepts": degree.orderBy(F.desc("degree"), "name").limit(top),
        "top_actors": actors.orderBy(F.desc("n"), "name").limit(top),
        "semantic_audit_samples": kept.orderBy(seeded).limit(samples),
        "semantic_label_distribution": nodes.where(F.col("label").isin(*LABELS)).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
        "retrieval_readiness_samples": edges.where(F.col("src_label").isin(*LABELS)).orderBy("src_label", "src", "rel", "dst_label", "dst").limit(top),
    }
