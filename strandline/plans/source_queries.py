"""Pages, entities and the trained router: what SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import entities, features
from strandline.operators import ml
from strandline.plans.feature_queries import BANK
from strandline.plans.registry import query, table
from strandline.sources import readers


@query("html_extract")
def html_extract(spark, sf_dir):
    return readers.html_elements(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("html_articles")
def html_articles(spark, sf_dir):
    """Pages rewritten as article pages: each heading begins an article, each paragraph is body."""
    h = F.regexp_replace(F.regexp_replace("html", r"<h[1-3][^>]*>", "<p class='pDieu'>"), r"<p>", "<p class='pNoiDung'>")
    return readers.html_articles(table(spark, sf_dir, "pages").select("page_id", h.alias("html")))


@query("ner_spans")
def ner_spans(spark, sf_dir):
    rules = (("NUMBER", 0.8, r"\d{4,}", True), ("QUOTE", 0.9, r'"([^"\n]{2,80})"', True))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(entities.entities(rules)(F.col("text"))).alias("e"))
    return d.select("doc_id", "e.*")


@query("script_variables")
def script_variables(spark, sf_dir):
    """Event properties as a script assigns them, with trailing commas."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("var x = 1; var data = ["), F.regexp_replace("props", r"\}$", ",}"), F.lit(",]; var y = '];';")).alias("js"))
    return e.select("event_id", F.from_json(readers.script_variable("data")(F.col("js")), "array<struct<k:bigint>>")[0]["k"].alias("k"))


@query("rf_router")
def rf_router(spark, sf_dir):
    """A forest over the lexical features tells the label of held-out documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("label")), "doc_id")
    x = d.select("doc_id", "label", *[c.cast("double").alias(n) for n, c in features.lexical(F.col("text"), BANK).items()])
    train, test = x.where("doc_id % 5 <> 0"), x.where("doc_id % 5 = 0")
    m = ml.pipeline(list(features.LEXICAL), trees=20).fit(ml.weighted(train))
    return ml.predict(m, test).select("doc_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))
