"""Ingest over documents: articles of sources, and triples read from answers that are made of the documents' own words and break off."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import ingest
from strandline.plans.registry import query, table
from strandline.sources import storage
from strandline.sources.readers import spread

_LABELS = ("LEGAL_CONCEPT", "ACTOR", "RIGHT", "UNKNOWN")
_RELS = ("regulates", "REQUIRES", "APPLIES_TO", "INVENTED")
#: Rows of an answer: label and name, relation, label and name, confidence, from words 2 i and 2 i + 1 of a text.
_ROWS = 6


def _answers(spark, sf_dir):
    """One answer a document, six rows of its first twelve words, cut somewhere."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ws = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    pick = lambda values, at: F.get(F.array(*(F.lit(v) for v in values)), (at % len(values)).cast("int"))

    def row(i):
        k = F.col("doc_id") + i * 3
        conf = F.concat(F.lit("0."), (F.lit(5) + (F.col("doc_id") + i) % 5).cast("string"), F.lit("5"))
        cells = F.concat(F.lit('["'), pick(_LABELS, k), F.lit('", "'), F.get("ws", i * 2), F.lit(' ] \\"of", "'), pick(_RELS, k + i), F.lit('", "'), pick(_LABELS, k + 1), F.lit('", "'), F.get("ws", i * 2 + 1), F.lit('"'))
        return F.when((F.col("doc_id") + i) % 4 == 0, F.concat(cells, F.lit("]"))).otherwise(F.concat(cells, F.lit(", "), conf, F.lit("]")))

    x = d.withColumn("ws", ws).where(F.size("ws") >= 2 * _ROWS).withColumn("rows", F.transform(F.sequence(F.lit(0), F.lit(_ROWS - 1)), row))
    whole = F.concat(F.lit("Here it is:\n["), F.array_join("rows", ", "), F.lit("]"))
    return x.select("doc_id", F.substr(whole, F.lit(1), (F.length(whole) - F.col("doc_id") % 11 * 25).cast("int")).alias("response"))


_PICK = lambda values, at: f"{list(values)}[({at}) % {len(values)} + 1]"
_T = f"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{2,}}') AS ws FROM documents), r AS (SELECT doc_id, i, {_PICK(_LABELS, 'doc_id + i * 3')} AS sl, ws[i * 2 + 1] || ' ] "of' AS sn, {_PICK(_RELS, 'doc_id + i * 4')} AS rel,
  {_PICK(_LABELS, 'doc_id + i * 3 + 1')} AS ol, ws[i * 2 + 2] AS obj, CASE WHEN (doc_id + i) % 4 <> 0 THEN '0.' || (5 + (doc_id + i) % 5) || '5' END AS conf FROM w, range({_ROWS}) t(i) WHERE len(ws) >= {2 * _ROWS}),
l AS (SELECT *, length(sl) + length(sn) + 1 + length(rel) + length(ol) + length(obj) + 20 + coalesce(length(conf) + 2, 0) AS size FROM r),
p AS (SELECT *, 13 + sum(size) OVER (PARTITION BY doc_id ORDER BY i) + 2 * i AS fin, 13 + sum(size) OVER (PARTITION BY doc_id) + 2 * {_ROWS - 1} + 1 - doc_id % 11 * 25 AS cut FROM l),
t AS (SELECT doc_id, sl AS subject_label, sn AS subject_name, rel AS relation, ol AS object_label, obj AS object_name, coalesce(conf::DOUBLE, 1.0::DOUBLE) AS confidence FROM p WHERE fin <= cut)"""
_K = f"""{_T}, a AS (SELECT doc_id, subject_label, subject_name AS s, upper(relation) AS rel, object_label, object_name AS o, confidence FROM t
  WHERE confidence >= 0.75 AND subject_label <> 'UNKNOWN' AND object_label <> 'UNKNOWN' AND relation <> 'INVENTED')"""


def _triples(spark, sf_dir):
    return ingest.triples(_answers(spark, sf_dir), "response")


@query("triple_salvage", f"WITH {_T} SELECT * FROM t")
def triple_salvage(spark, sf_dir):
    """The whole rows of every answer; quoted brackets and quotes in them are letters."""
    return _triples(spark, sf_dir)


@query(
    "triple_funnel",
    f"""WITH {_T}, k AS (SELECT * FROM t WHERE confidence >= 0.75), e AS (SELECT subject_label AS label, subject_name AS name FROM k UNION ALL SELECT object_label, object_name FROM k)
SELECT 'triples_generated' AS name, count(*) AS n FROM t UNION ALL SELECT 'triples_kept', count(*) FROM k UNION ALL SELECT 'triples_filtered', (SELECT count(*) FROM t) - count(*) FROM k
UNION ALL SELECT 'unique_concepts', count(DISTINCT name) FROM e WHERE label = 'LEGAL_CONCEPT' UNION ALL SELECT 'unique_actors', count(DISTINCT name) FROM e WHERE label = 'ACTOR' UNION ALL SELECT 'unique_rights', count(DISTINCT name) FROM e WHERE label = 'RIGHT'
UNION ALL SELECT 'unique_obligations', 0 UNION ALL SELECT 'unique_conditions', 0 UNION ALL SELECT 'rel:' || relation, count(*) FROM k WHERE relation IN ('REQUIRES', 'APPLIES_TO') GROUP BY relation""",
)
def triple_funnel(spark, sf_dir):
    """Counts of the pass that writes the kept triples, the names of each label, and the relations."""
    t = _triples(spark, sf_dir)
    reports = ingest.pilot_reports(t.withColumn("article_id", F.col("doc_id").cast("string")), t.select(F.col("doc_id").cast("string").alias("article_id")), "doc_id", storage.scratch(spark, "triples"))
    return reports["pilot_report"].unionByName(reports["top_relations"].select(F.concat(F.lit("rel:"), "relation").alias("name"), "n"))


@query(
    "semantic_ingest",
    f"""WITH {_K}, h AS (SELECT a.*, doc_id % 3 > 0 AS there FROM a),
n AS (SELECT DISTINCT subject_label AS label, s AS name FROM h UNION SELECT object_label, o FROM h),
e AS (SELECT subject_label AS sl, s, rel, object_label AS ol, o FROM h GROUP BY ALL UNION ALL SELECT DISTINCT 'LegalArticle', doc_id::VARCHAR, 'MENTIONS', l, x FROM (SELECT doc_id, subject_label AS l, s AS x FROM h WHERE there UNION SELECT doc_id, object_label, o FROM h WHERE there))
SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel""",
)
def semantic_ingest(spark, sf_dir):
    """Allowed triples as nodes and edges; two thirds of the articles exist and mention both ends."""
    t = _triples(spark, sf_dir).withColumn("article_id", F.col("doc_id").cast("string"))
    articles = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").cast("string").alias("article_id"))
    nodes, edges = ingest.semantic(ingest.allowed(ingest.confident(t)), articles, "doc_id")
    count = lambda kind, df, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count("node", nodes, "label").unionByName(count("edge", edges, "rel"))


@query(
    "structural_ingest",
    r"""WITH c AS (SELECT doc_id, source || '::' || doc_id % 400 AS cid, source AS law, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id END AS title, trim(coalesce(text, ''), E' \t\n\r\f\x0B') AS content FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT * FROM c WHERE length(content) >= 20), a AS (SELECT cid, arg_max(law, doc_id) AS law_id, arg_max(title, CASE WHEN title IS NOT NULL THEN doc_id END) AS title, arg_max(content, doc_id) AS content FROM f GROUP BY cid)
SELECT cid AS article_id, law_id, title, md5(substr(content, 1, 8000)) AS content, (SELECT count(*) FROM f WHERE f.law = a.law_id) AS chunks, (SELECT count(DISTINCT law) FROM f) AS docs, (SELECT count(DISTINCT law || '|' || cid) FROM f) AS edges FROM a""",
)
def structural_ingest(spark, sf_dir):
    """Documents by source, articles by id (the last chunk wins, a title is never lost), and their edges."""
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.concat("source", F.lit("::"), F.col("doc_id") % 400).alias("canonical_id"), (F.col("doc_id") % 5 != 0).alias("has_canonical_id"), F.col("source").alias("law_number"), (F.col("doc_id") % 400).cast("string").alias("article_number"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t"), "doc_id")).alias("title"), F.col("text").alias("content"))
    docs, articles, edges = ingest.structural(c, "doc_id", "corpus")
    per = c.where("has_canonical_id").withColumn("t", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).where(F.length("t") >= 20).groupBy(F.col("law_number").alias("law_id")).agg(F.count(F.lit(1)).alias("chunks"))
    totals = docs.agg(F.count(F.lit(1)).alias("docs")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row each
    return articles.join(per, "law_id").join(F.broadcast(totals)).select("article_id", "law_id", "title", F.md5("content").alias("content"), "chunks", "docs", "edges")
