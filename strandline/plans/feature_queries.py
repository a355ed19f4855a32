"""Query features, ambiguity, history, routing and text functions over benchmark, documents and conversations.

The tables hold no Vietnamese, so the banks that fire here are the English ones and a small one of the tables' own words;
the Vietnamese banks are covered by the tests' fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import ambiguity, features, history, routing, text
from strandline.functions import patterns as P
from strandline.operators import evaluate
from strandline.plans.registry import query, table
from strandline.sources.readers import spread

#: A bank whose patterns occur in the tables; all are plain words, which both engines match alike.
BANK = P.Lexical(
    graph_keywords=("thing", "ation", "order", "zu"), cross_doc=("the.*and", "der.*die", "le.*les"), legal_refs=(r"\d+/\d+", r"[0-9]{4,}", "token"), article_ref=r"th[aeiou]\s*n",
    yes_no=("^is", "password"), factoid=("^the", "^of"), ambiguity=("or", "this", "wh"),
    structure={"has_conditional_structure": "if|unless", "has_negation": "not|nicht", "has_comparison": "than|als", "has_enumeration": r"\|", "has_procedure_marker": "step|ing", "has_multi_hop_connector": "and.{0,20}and"},
)

_LEX = r"""SELECT doc_id, CAST(length(t) AS INTEGER) AS query_length_chars, CAST(len(list_filter(regexp_split_to_array(t, '[\s\x0B]+'), lambda w: w <> '')) AS INTEGER) AS query_length_words,
CAST(regexp_matches(t, '(?i)thing')::INT + regexp_matches(t, '(?i)ation')::INT + regexp_matches(t, '(?i)order')::INT + regexp_matches(t, '(?i)zu')::INT AS INTEGER) AS graph_keyword_count,
CAST(len(list_distinct(list_transform(regexp_extract_all(t, '(?i)\d+/\d+') || regexp_extract_all(t, '(?i)[0-9]{4,}') || regexp_extract_all(t, '(?i)token'), lambda x: lower(trim(x))))) AS INTEGER) AS legal_reference_count,
CAST(len(regexp_extract_all(t, '(?i)th[aeiou]\s*n')) AS INTEGER) AS dieu_reference_count, (len(regexp_extract_all(t, '(?i)th[aeiou]\s*n')) >= 2)::INT AS multi_article_ref,
(regexp_matches(t, '(?i)^is') OR regexp_matches(t, '(?i)password'))::INT AS is_yes_no_question, (regexp_matches(t, '(?i)^the') OR regexp_matches(t, '(?i)^of'))::INT AS is_factoid_question,
CAST(regexp_matches(t, '(?i)the.*and')::INT + regexp_matches(t, '(?i)der.*die')::INT + regexp_matches(t, '(?i)le.*les')::INT AS INTEGER) AS cross_doc_signal_count,
regexp_matches(t, '(?i)if|unless')::INT AS has_conditional_structure, regexp_matches(t, '(?i)not|nicht')::INT AS has_negation, regexp_matches(t, '(?i)than|als')::INT AS has_comparison,
regexp_matches(t, '\|')::INT AS has_enumeration, regexp_matches(t, '(?i)step|ing')::INT AS has_procedure_marker,
CAST(regexp_matches(t, '(?i)or')::INT + regexp_matches(t, '(?i)this')::INT + regexp_matches(t, '(?i)wh')::INT AS INTEGER) AS ambiguity_score, regexp_matches(t, '(?i)and.{0,20}and')::INT AS has_multi_hop_connector
FROM (SELECT doc_id, trim(text, E' \t\n\r\f\x0B') AS t FROM documents)"""


@query("features_lexical", _LEX)
def features_lexical(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[c.alias(n) for n, c in features.lexical(F.col("text"), BANK).items()])


def _count(p):
    return f"len(regexp_extract_all(t, '(?i){p}'))"


_B = r"\b"
_CPLX = rf"""WITH c AS (SELECT doc_id, t, {_count(P.EN.sub_question)} AS sq, {_count(P.EN.article)} AS art, {_count(P.EN.law_name)} AS laws, {_count(P.EN.conditional)} AS cond, {_count(P.EN.multi_hop)} AS mhv,
{_count(P.EN.comparative)} AS comp, {_count(P.EN.authority)} AS auth, {_count(P.EN.effect)} AS eff, {_count(P.EN.strong_effect)} AS strong, {_count(P.EN.procedural)} AS proc, {_count(P.EN.relation)} AS rel,
regexp_matches(t, '(?i){P.EN.effective_date}') AS dated, greatest(len(list_filter(regexp_split_to_array(trim(t, E' \t\n\r\f\x0B'), '[\s\x0B]+'), lambda w: w <> '')), 1) AS tok FROM (SELECT doc_id, text AS t FROM documents))
SELECT doc_id, CAST(CASE WHEN laws >= 2 OR mhv >= 2 OR strong >= 2 OR (cond >= 2 AND laws >= 1) OR (sq >= 3 AND art = 0) OR (rel >= 1 AND laws >= 2) THEN 3
WHEN dated AND strong = 0 AND auth = 0 AND rel = 0 AND sq = 0 AND proc <= 1 THEN 1
WHEN (art >= 2 AND sq >= 1) OR mhv >= 1 OR comp >= 1 OR (tok > 20 AND art >= 1 AND sq >= 1) OR (auth >= 1 AND (sq >= 1 OR tok > 16 OR art >= 1)) OR strong >= 1 OR (eff >= 1 AND (sq >= 1 OR cond >= 1 OR art >= 1)) OR proc >= 2
 OR (proc >= 1 AND (sq >= 1 OR auth >= 1 OR tok > 20)) OR rel >= 1 OR (auth >= 1 AND tok > 12) OR (proc >= 1 AND cond >= 1) OR (rel >= 1 AND cond >= 1) THEN 2 ELSE 1 END AS INTEGER) AS complexity_level,
CAST(sq AS INTEGER) AS sub_question_count, CAST(cond AS INTEGER) AS conditional_depth, CAST(comp AS INTEGER) AS comparative_depth, CAST(proc AS INTEGER) AS procedural_count, CAST(rel AS INTEGER) AS multi_entity_relation_count FROM c"""


@query("features_complexity", _CPLX)
def features_complexity(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query")))
    out = features.with_features(d, "query", BANK, P.EN)
    return out.select("doc_id", "complexity_level", "sub_question_count", "conditional_depth", "comparative_depth", "procedural_count", "multi_entity_relation_count")


@query("feature_vectors")
def feature_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return features.vector(features.with_features(d)).select("item_id", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


@query(
    "missing_entity_check",
    r"""WITH t AS (SELECT item_id, len(list_filter(regexp_split_to_array(trim(text, E' \t\n\r\f\x0B'), '[\s\x0B]+'), lambda w: w <> '')) AS n,
len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w = 'ai')) AS k FROM benchmark),
s AS (SELECT item_id, CASE WHEN k > 1 THEN least(0.5::DOUBLE, round(k * 0.15::DOUBLE, 6)) WHEN k = 1 THEN 0.0::DOUBLE WHEN n < 5 THEN 0.7::DOUBLE WHEN n < 10 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS score FROM t)
SELECT item_id, score, score >= 0.6 AS is_ambiguous FROM s""",
)
def missing_entity_check(spark, sf_dir):
    """Texts that name nothing the bank knows but a French verb that reads as its `who`: the length speaks."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return ambiguity.detect(b).select("item_id", F.col("ambiguity.score").alias("score"), F.col("ambiguity.is_ambiguous").alias("is_ambiguous"))


@query("history_resolution")
def history_resolution(spark, sf_dir):
    """The last turn, resolved in the text of all turns before it."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    before = F.transform(F.slice("ts", 1, F.size("ts") - 1), lambda t: t["text"])
    c = c.select("conv_id", F.element_at("ts", -1)["text"].alias("query"), F.array_join(before, "\n").alias("history"))
    return history.with_history(c).select("conv_id", F.col("resolution.status").alias("status"), F.col("resolution.reason").alias("reason"), F.size("resolution.candidates").alias("candidates"))


_ROUTES = ("dense_retrieval", "graph_traversal", "hybrid_reasoning", "clarify")
_STATES = ("not_needed", "resolved", "no_history", "irrelevant_history", "conflicting_history", "unresolved")
_LEVELS = ("simple", " Moderate ", "complex", "")
#: What the stages said of a turn, from the digits of a number h: each reads the same in both dialects but for integer division.
_SAID = {
    "c1": "CAST(0.4 + 0.05 * (h // 3 % 13) AS DOUBLE)", "c2": "CAST(0.7 + 0.01 * (h // 41 % 25) AS DOUBLE)", "amb": "CAST(0.5 + 0.05 * (h // 7 % 11) AS DOUBLE)",
    "ctx": "h // 11 % 3 = 0", "xdoc": "h // 13 % 7 = 0", "pron": "h // 17 % 2 = 0", "mis": "h // 19 % 4 = 0", "multi": "h // 23 % 5 = 0", "inc": "h // 29 % 6 = 0", "off": "h // 31 % 17 = 0", "ref_named": "h // 37 % 3 > 0",
    "s2_mis": "h // 43 % 5 = 0", "s2_pron": "h // 47 % 4 = 0", "s2_mul": "h // 53 % 6 = 0", "s2_inc": "h // 59 % 5 = 0", "asks": "h // 61 % 3 > 0", "subs": "h // 67 % 4", "parsed": "h // 71 % 3 > 0",
    "spec": "h // 73 % 5 // 4", "auth": "h // 79 % 7 // 6", "eff": "h // 83 % 6 // 5", "proc": "h // 89 % 5 // 3", "rel": "h // 97 % 6 // 5", "ent": "h // 101 % 4 // 3", "lvl": "h // 103 % 8 // 3 + 1", "sq": "h // 107 % 7 // 3", "cond": "h // 109 % 4 // 2",
    "mh": "CAST(0.1 * (h // 113 % 7) AS DOUBLE)",
}
#: Columns of the rules and the names above.
_NAMED = {
    "ctxref": "ctx", "has_pronoun": "pron", "missing_entity": "mis", "multi_interpretation": "multi", "incomplete_context": "inc", "ablation": "off", "has_referent": "ref_named", "s2_missing_entity": "s2_mis", "s2_pronoun": "s2_pron",
    "s2_multi": "s2_mul", "s2_incomplete": "s2_inc", "s2_asks": "asks", "s2_sub_questions": "subs", "s2_complexity": "level", "law_specificity": "spec", "authority_chain_count": "auth", "legal_effect_count": "eff", "procedural_count": "proc",
    "multi_entity_relation_count": "rel", "entity_count": "ent", "complexity_level": "lvl", "sub_question_count": "sq", "conditional_depth": "cond", "legal_reference_count": "ref", "graph_keyword_count": "kw",
}
_KEYS = ["conv_id", "turn", "s1", "s2"]
_H = "(conv_id * 7919 + turn * 104729 + i * 1299709 + 17) * 48271 % 2147483647"
_REF, _KW = "(section|chapter|license|version)", "(the|and|die|und|les|los)"


def _said(spark, sf_dir):
    """Every turn of every conversation under every pair of the stages' routes, with references and keywords counted in its text."""
    t = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    pick = lambda values, at: F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))
    x = t.withColumn("h", F.expr(_H)).select(
        "conv_id", "turn", "h", pick(_ROUTES, F.col("i") % 4).alias("s1"), pick(_ROUTES, F.expr("i div 4")).alias("s2"), pick(_STATES, F.expr("h % 6")).alias("hist"), pick(_LEVELS, F.expr("h div 127 % 4")).alias("level"),
        F.least(F.regexp_count(F.lower("text"), F.lit(_REF)), F.lit(2)).alias("ref"), F.floor(F.regexp_count("text", F.lit(f" {_KW}")) / 4).alias("kw"), *(F.expr(e.replace("//", "div")).alias(n) for n, e in _SAID.items()),
    )
    return routing.defaults(x.withColumns({c: F.col(n) for c, n in _NAMED.items()} | {"is_ambiguous": F.col("amb") >= 0.6}))


#: The same rows, with the signals of the rules.
_G = rf"""h AS (SELECT conv_id, turn, coalesce(text, '') AS text, i, {_H} AS h FROM conversations, range(16) r(i)),
x AS (SELECT conv_id, turn, {list(_ROUTES)}[i % 4 + 1] AS s1, {list(_ROUTES)}[i // 4 + 1] AS s2, {list(_STATES)}[h % 6 + 1] AS hist, {list(_LEVELS)}[h // 127 % 4 + 1] AS level,
  least(len(regexp_extract_all(lower(text), '{_REF}')), 2) AS ref, len(regexp_extract_all(text, ' {_KW}')) // 4 AS kw, {', '.join(f'{e} AS {n}' for n, e in _SAID.items())} FROM h),
y AS (SELECT *, hist IN ('no_history', 'irrelevant_history', 'conflicting_history', 'unresolved') AS unres, eff >= 1 OR auth >= 1 OR kw >= 2 OR xdoc OR rel >= 1 OR mh >= 0.45 AS heavy,
  ref >= 2 OR spec >= 1 OR ent >= 1 OR auth >= 1 OR xdoc AS concrete, s2_mis OR s2_pron OR s2_mul OR s2_inc OR mis OR multi OR inc AS severe FROM x),
g AS (SELECT *, concrete OR (NOT ctx AND (rel >= 1 OR kw >= 2 OR lvl >= 3 OR sq >= 2 OR proc >= 2)) AS answerable FROM y)"""


@query(
    "override_policy",
    f"""WITH {_G} SELECT conv_id, turn, s1, s2, CASE
WHEN s1 = 'clarify' AND hist = 'resolved' AND ref_named AND s2 <> 'clarify' AND c2 >= 0.80 THEN 'override_clarify_to_retrieval_resolved_history'
WHEN s2 <> 'clarify' AND s2 = s1 AND c2 >= 0.82 AND (NOT ctx OR (hist = 'resolved' AND ref_named) OR answerable) THEN 'restore_stage1_retrieval_after_stage2_confirmation'
WHEN s1 IN ('graph_traversal', 'hybrid_reasoning') AND s2 = s1 AND c2 >= 0.80 AND NOT ctx THEN 'restore_reasoning_route_after_ambiguity_candidate'
WHEN s1 = 'clarify' AND s2 <> 'clarify' AND c2 >= 0.82 AND (NOT ctx OR answerable) AND (heavy OR answerable) THEN 'override_clarify_to_relation_heavy_retrieval'
WHEN s1 = 'clarify' AND s2 = 'dense_retrieval' AND c2 >= 0.82 AND NOT severe AND NOT ctx THEN 'override_clarify_to_dense_factoid'
WHEN s2 = 'clarify' AND hist = 'resolved' AND ref_named AND NOT (s2_mis OR s2_mul OR s2_inc) THEN 'resolved_history_blocks_unnecessary_clarify'
WHEN s2 = 'clarify' AND c2 < 0.8 THEN 'stage2_clarify_below_threshold'
WHEN s2 = 'clarify' AND hist = 'conflicting_history' THEN 'override_to_clarify_conflicting_history'
WHEN s2 = 'clarify' AND unres AND ctx THEN 'override_to_clarify_unresolved_history'
WHEN s2 = 'clarify' AND amb >= 0.6 AND severe THEN CASE WHEN off THEN 'ablation_no_severe_override_active' WHEN s2_mis OR mis THEN 'override_to_clarify_missing_entity'
  WHEN s2_mul OR multi THEN 'override_to_clarify_multi_interpretation' ELSE 'override_to_clarify_severe_ambiguity' END
WHEN s2 = 'clarify' AND ctx AND NOT (hist = 'resolved' AND ref_named) THEN 'override_to_clarify_unresolved_context_reference'
WHEN s2 = 'clarify' AND s1 = 'dense_retrieval' AND ref = 0 AND spec = 0 AND ent = 0 AND (mis OR multi) THEN 'override_to_clarify_dense_underspecified_target'
WHEN s1 = 'dense_retrieval' AND s2 = 'graph_traversal' AND c2 >= 0.85 AND (auth >= 1 OR eff >= 1 OR proc >= 1 OR rel >= 1 OR kw >= 2 OR mh >= 0.45 OR subs >= 2) THEN 'rescue_dense_to_graph_strong_reasoning_signal'
WHEN s1 = 'graph_traversal' AND s2 = 'hybrid_reasoning' AND c2 >= 0.88 AND (xdoc OR ref >= 2 OR lvl >= 3 OR ref = 0) THEN 'rescue_graph_to_hybrid_cross_document_signal_or_ood'
WHEN s1 = 'dense_retrieval' AND s2 = 'hybrid_reasoning' AND c2 >= 0.82 AND (xdoc OR ref >= 2 OR lvl >= 3 OR sq >= 2 OR mh >= 0.30 OR kw >= 2) THEN 'rescue_dense_to_hybrid_strong_structural_signal'
WHEN s2 = 'clarify' AND c2 >= 0.92 AND amb >= 0.75 AND severe AND NOT off THEN 'rescue_to_clarify_severe_ambiguity'
WHEN s1 = 'dense_retrieval' AND s2 = 'graph_traversal' AND c2 >= 0.82 AND (ref >= 1 OR spec >= 1) THEN 'rescue_dense_to_graph_doc_specific_lookup'
ELSE 'blocked_by_rescue_only_policy' END AS reason FROM g""",
)
def override_policy(spark, sf_dir):
    return _said(spark, sf_dir).select(*_KEYS, routing.stage2_override()["reason"].alias("reason"))


@query(
    "ambiguity_override",
    f"""WITH {_G} SELECT conv_id, turn, s1, s2, reason, reason LIKE 'override%' OR reason LIKE '%unresolved_pronoun_on%' AS allow FROM (SELECT *, CASE WHEN off THEN 'ablation_no_severe_override_active' WHEN amb < 0.8 THEN 'ambiguity_below_clarify_threshold'
WHEN hist = 'resolved' THEN 'resolved_history_blocks_auto_clarify' WHEN heavy AND NOT ctx THEN 'blocked_auto_clarify_for_clear_relation_heavy_query'
WHEN unres AND ctx THEN 'override_to_clarify_' || hist WHEN mis OR multi OR inc THEN 'override_to_clarify_semantic_ambiguity'
WHEN s1 IN ('graph_traversal', 'hybrid_reasoning') THEN CASE WHEN amb >= 0.95 AND pron THEN 'extreme_unresolved_pronoun_on_reasoning_route' ELSE 'blocked_auto_clarify_for_reasoning_route' END
WHEN s1 = 'dense_retrieval' THEN CASE WHEN amb >= 0.95 AND c1 <= 0.65 AND pron THEN 'high_unresolved_pronoun_on_dense_route' ELSE 'blocked_auto_clarify_without_unresolved_pronoun' END
ELSE 'no_ambiguity_override_rule_matched' END AS reason FROM g)""",
)
def ambiguity_override(spark, sf_dir):
    return _said(spark, sf_dir).withColumn("o", routing.ambiguity_override()).select(*_KEYS, "o.reason", "o.allow")


@query(
    "stage2_trigger",
    f"""WITH {_G}, t AS (SELECT *, ref >= 1 OR kw >= 1 OR spec >= 1 OR auth >= 1 OR eff >= 1 AS strong, xdoc OR lvl >= 3 OR sq >= 2 OR cond >= 2 OR mh >= 0.45 OR ref >= 1 OR spec >= 1 OR kw >= 1 OR auth >= 1 OR eff >= 1 OR proc >= 1 OR rel >= 1 AS reasoning FROM g)
SELECT conv_id, turn, s1, s2, CASE WHEN s1 = 'dense_retrieval' AND c1 >= 0.95 AND amb <= 0.4 AND NOT strong THEN '' ELSE concat_ws(',', CASE WHEN c1 < 0.5 THEN 'low_confidence' END, CASE WHEN amb >= 0.6 THEN 'ambiguous' END,
CASE WHEN s1 = 'dense_retrieval' AND strong AND (c1 <= 0.90 OR heavy) THEN 'dense_with_strong_signal' END, CASE WHEN reasoning AND c1 <= 0.90 THEN 'reasoning_signal' END, CASE WHEN s1 = 'clarify' AND amb < 0.6 THEN 'clarify_without_ambiguity' END,
CASE WHEN ctx AND hist IN ('no_history', 'irrelevant_history', 'conflicting_history') THEN 'unresolved_reference' END, CASE WHEN ref = 0 THEN 'no_reference' END) END AS reasons FROM t""",
)
def stage2_trigger(spark, sf_dir):
    return _said(spark, sf_dir).select(*_KEYS, F.array_join(routing.stage2_trigger()["reasons"], ",").alias("reasons"))


@query(
    "stage2_guardrail",
    f"""WITH {_G}, q AS (SELECT *, s2_mis OR s2_pron OR s2_mul OR s2_inc AS flag FROM g), r AS (SELECT *, CASE
WHEN s2 = 'clarify' AND NOT asks THEN 'clarify_without_question'
WHEN s1 = 'dense_retrieval' AND s2 = 'graph_traversal' AND (c2 < 0.80 OR (subs < 2 AND level NOT IN (' Moderate ', 'complex'))) THEN 'blocked_dense_to_graph_without_strong_multi_evidence'
WHEN s1 = 'graph_traversal' AND s2 = 'dense_retrieval' AND (c2 < 0.85 OR flag) THEN 'blocked_graph_to_dense_without_high_confidence_and_clean_ambiguity'
WHEN s1 = 'hybrid_reasoning' AND s2 = 'graph_traversal' AND (c2 < 0.88 OR flag) THEN 'blocked_hybrid_to_graph_without_high_confidence'
WHEN s1 = 'hybrid_reasoning' AND s2 = 'clarify' AND (c2 < 0.90 OR NOT (s2_mis OR s2_pron OR s2_mul)) THEN 'blocked_hybrid_to_clarify_without_severe_ambiguity' END AS reason FROM q)
SELECT conv_id, turn, s1, s2, reason IS NOT NULL AS blocked, reason, CASE WHEN reason IS NULL THEN s2 ELSE s1 END AS route FROM r""",
)
def stage2_guardrail(spark, sf_dir):
    return _said(spark, sf_dir).withColumn("g", routing.guardrail()).select(*_KEYS, "g.blocked", "g.reason", "g.route")


@query(
    "factoid_rescue",
    """WITH x AS (SELECT o_orderkey AS id, ['dense_retrieval', 'graph_traversal', 'hybrid_reasoning', 'clarify'][o_custkey % 4 + 1] AS r, o_orderkey % 2 = 0 AS f, o_orderkey % 3 + 1 AS lvl, o_custkey % 2 AS cond, o_orderkey % 5 // 4 AS auth FROM orders)
SELECT id, CASE WHEN r IN ('graph_traversal', 'hybrid_reasoning') AND f AND lvl = 1 AND cond = 0 AND auth = 0 THEN 'dense_retrieval' ELSE r END AS route,
CASE WHEN r IN ('graph_traversal', 'hybrid_reasoning') AND f AND lvl = 1 AND cond = 0 AND auth = 0 THEN 0.99::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM x""",
)
def factoid_rescue(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.array(*(F.lit(r) for r in _ROUTES))[(c % 4).cast("int")].alias("r"), (k % 2 == 0).cast("int").alias("is_factoid_question"), (k % 3 + 1).alias("complexity_level"), (c % 2).alias("conditional_depth"), F.floor(k % 5 / 4).alias("authority_chain_count"))
    return routing.defaults(o).withColumn("x", routing.factoid_rescue(F.col("r"), F.lit(0.5))).select("id", "x.route", "x.confidence")


@query(
    "parse_fallback",
    f"""WITH {_G} SELECT conv_id, turn, s1, s2, CASE WHEN parsed THEN s2 ELSE s1 END AS route, round(CASE WHEN parsed THEN c2 ELSE least(1.0, c1 * 0.9::DOUBLE) END, 6) AS confidence, NOT parsed AS fell_back FROM g""",
)
def parse_fallback(spark, sf_dir):
    x = _said(spark, sf_dir).withColumn("x", routing.parse_fallback(F.col("parsed")))
    return x.select(*_KEYS, "x.route", F.round("x.confidence", 6).alias("confidence"), "x.fell_back")


@query(
    "route_dispatch",
    """WITH x AS (SELECT o_orderkey AS id, ['dense_retrieval', 'graph_traversal', 'hybrid_reasoning', 'clarify', 'other'][o_custkey % 5 + 1] AS r, o_orderkey % 2 = 0 AS v, o_orderkey % 3 = 0 AS g, CASE WHEN o_orderkey % 4 > 1 THEN o_orderstatus END AS k FROM orders)
SELECT id, CASE r WHEN 'dense_retrieval' THEN CASE WHEN NOT v AND g THEN 'dense_retrieval->graph_traversal' ELSE r END WHEN 'hybrid_reasoning' THEN CASE WHEN k IS NULL THEN r ELSE r || ':' || k END WHEN 'other' THEN 'dense_retrieval' ELSE r END AS pipeline FROM x""",
)
def route_dispatch(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("r", F.array(*(F.lit(r) for r in (*_ROUTES, "other")))[(F.col("o_custkey") % 5).cast("int")])
    return o.select(k.alias("id"), routing.dispatch(F.col("r"), k % 2 == 0, k % 3 == 0, F.when(k % 4 > 1, F.col("o_orderstatus"))).alias("pipeline"))


@query(
    "clarify_sanity",
    f"""WITH {_G}, k AS (SELECT *, s2 = 'clarify' AND hist = 'resolved' AND NOT (s2_mis OR s2_mul OR s2_inc) AS named, s2 = 'clarify' AND s1 <> 'clarify' AND hist = 'no_history' AND ctx AND answerable AS alone FROM g)
SELECT conv_id, turn, s1, s2, CASE WHEN named THEN 'resolved_history_blocks_unnecessary_clarify' WHEN alone THEN 'self_contained_query_blocks_unnecessary_clarify' END AS reason,
CASE WHEN named THEN CASE WHEN heavy THEN CASE WHEN xdoc OR ref >= 2 OR lvl >= 3 OR sq >= 2 THEN 'hybrid_reasoning' ELSE 'graph_traversal' END WHEN ctx AND ref_named THEN 'graph_traversal' ELSE 'dense_retrieval' END WHEN alone THEN s1 ELSE s2 END AS route FROM k""",
)
def clarify_sanity(spark, sf_dir):
    need = F.col("s2_mis") | F.col("s2_mul") | F.col("s2_inc")
    x = _said(spark, sf_dir).withColumn("x", routing.clarify_sanity(F.col("s2"), F.when(F.col("ref_named"), "Nghị định 1").otherwise("việc này"), need))
    return x.select(*_KEYS, "x.reason", "x.route")


@query(
    "routing_fallback",
    f"""WITH f AS ({_LEX}) SELECT doc_id, CASE WHEN ambiguity_score >= 1 THEN 'clarify' WHEN cross_doc_signal_count >= 2 THEN 'hybrid_reasoning' WHEN (graph_keyword_count + has_multi_hop_connector) / 3.0::DOUBLE > 0.5 OR has_comparison > 0 OR legal_reference_count > 1 OR graph_keyword_count > 1 THEN 'graph_traversal' ELSE 'dense_retrieval' END AS route FROM f""",
)
def routing_fallback(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", "text", *[c.alias(n) for n, c in features.lexical(F.col("text"), BANK).items()])
    f = routing.defaults(f.withColumn("xdoc", F.col("cross_doc_signal_count") >= 2).withColumn("mh", F.least(F.lit(1.0), (F.col("graph_keyword_count") + F.col("has_multi_hop_connector")) / 3)))
    return f.select("doc_id", routing.rule_route(F.col("text"))["route"].alias("route"))


@query(
    "evidence_cascade",
    """WITH e AS (SELECT o_custkey AS q, CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END AS p, o_orderkey AS item FROM orders), m AS (SELECT q, min(p) AS p FROM e GROUP BY q)
SELECT e.q, e.item, CASE e.p WHEN 1 THEN 'direct' WHEN 2 THEN 'semantic' ELSE 'keyword' END AS kg_source FROM e JOIN m USING (q, p)""",
)
def evidence_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.when(F.col("o_totalprice") > 300000, 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    e = o.select(F.col("o_custkey").alias("q"), p.alias("p"), F.col("o_orderkey").alias("item")).withColumn("src", F.when(F.col("p") == 1, "direct").when(F.col("p") == 2, "semantic").otherwise("keyword"))
    return routing.first_evidence(e, "q", "p", "src").select("q", "item", "kg_source")


@query("json_repair_parse", "SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair_parse(spark, sf_dir):
    """Properties wrapped as a model's answer, with a fence and a trailing comma, are read all the same."""
    said = F.concat(F.lit("<think>so</think>```json\n"), F.regexp_replace("props", r"\}$", ", }"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text.repair_json(said), "k bigint")["k"].alias("k"))


@query("alias_expansion", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(' ' || text || ' ', ' the ', ' THE ', 'g'), '[ ]+', ' ', 'g'))) AS m FROM documents")
def alias_expansion(spark, sf_dir):
    x = F.regexp_replace(F.concat(F.lit(" "), "text", F.lit(" ")), " the ", " THE ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(x, "[ ]+", " "))).alias("m"))


@query(
    "token_f1",
    r"""WITH p AS (SELECT a.item_id, list_filter(regexp_split_to_array(regexp_replace(lower(a.text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(regexp_replace(lower(b.text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS y
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), o AS (SELECT item_id, len(x) AS nx, len(y) AS ny, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS same FROM p)
SELECT item_id, round(2.0::DOUBLE * same / (nx + ny), 6) AS f1 FROM o""",
)
def token_f1(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("gold"))
    return b.join(n, "item_id").select("item_id", F.round(evaluate.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))
