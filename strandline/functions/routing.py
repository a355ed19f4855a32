"""Routing decisions as first-match-wins cascades over feature columns; each returns its reason.

Columns: the features' names; mh (multi_hop_score), amb (ambiguity score), hist (history status), ctxref, xdoc, c1 and c2
(confidences of the stages), s1 and s2 (their routes), and the ambiguity flags. defaults() fills in what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources import storage

#: Fixed values of the decision rules.
GREETING = r"(?iuU)^\s*(xin\s+chào|chào|hello|hi|hey|alo)(\s+(bạn|em|anh|chị|there))?\s*[!.?]*\s*$"
FORCE, LOW_CONFIDENCE, AMBIGUOUS = 0.45, 0.5, 0.6
GRAPH_FLOOR, GRAPH_CONFIDENCE = 0.16, 0.55
UNRESOLVED = ("no_history", "irrelevant_history", "conflicting_history")
NUMBERS = (
    "legal_reference_count", "graph_keyword_count", "law_specificity", "authority_chain_count", "legal_effect_count", "procedural_count", "multi_entity_relation_count",
    "entity_count", "complexity_level", "sub_question_count", "conditional_depth", "is_factoid_question", "has_comparison", "ambiguity_score", "mh", "amb", "c1", "c2", "s2_sub_questions",
)
FLAGS = ("ctxref", "xdoc", "has_pronoun", "missing_entity", "multi_interpretation", "incomplete_context", "vague_reference", "is_ambiguous", "has_referent", "ablation", "s2_missing_entity", "s2_pronoun", "s2_multi", "s2_incomplete", "s2_asks")


def defaults(df: DataFrame) -> DataFrame:
    for n in NUMBERS:
        df = df.withColumn(n, F.coalesce(F.col(n), F.lit(0)) if n in df.columns else F.lit(0))
    for n in FLAGS:
        df = df.withColumn(n, F.coalesce(F.col(n), F.lit(False)) if n in df.columns else F.lit(False))
    for n, v in (("hist", "not_needed"), ("s1", "dense_retrieval"), ("s2", "dense_retrieval"), ("s2_complexity", "")):
        df = df.withColumn(n, F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v))
    return df


def _c(short: str) -> Column:
    names = {"ref": "legal_reference_count", "kw": "graph_keyword_count", "spec": "law_specificity", "auth": "authority_chain_count", "eff": "legal_effect_count", "proc": "procedural_count", "rel": "multi_entity_relation_count", "ent": "entity_count", "lvl": "complexity_level", "sq": "sub_question_count", "cond": "conditional_depth"}
    return F.col(names.get(short, short))


def signals() -> dict[str, Column]:
    ref, kw, spec, auth, eff, proc, rel, ent, lvl, sq, cond = (_c(x) for x in ("ref", "kw", "spec", "auth", "eff", "proc", "rel", "ent", "lvl", "sq", "cond"))
    mh, xdoc = F.col("mh"), F.col("xdoc")
    concrete = (ref >= 2) | (spec >= 1) | (ent >= 1) | (auth >= 1) | xdoc
    structural = (rel >= 1) | (kw >= 2) | (lvl >= 3) | (sq >= 2) | (proc >= 2)
    return {
        "reasoning": xdoc | (lvl >= 3) | (sq >= 2) | (cond >= 2) | (mh >= FORCE) | (ref >= 1) | (spec >= 1) | (kw >= 1) | (auth >= 1) | (eff >= 1) | (proc >= 1) | (rel >= 1),
        "relation_heavy": (eff >= 1) | (auth >= 1) | (kw >= 2) | xdoc | (rel >= 1) | (mh >= FORCE),
        "answerable": F.when(F.col("ctxref"), concrete).otherwise(concrete | structural),
    }


def rule_route(query: Column) -> Column:
    """Route and confidence without a model: greeting, clarification, cross-document, graph, dense."""
    kw, ref = F.col("graph_keyword_count"), F.col("legal_reference_count")
    graph = (F.col("mh") > 0.5) | (F.col("has_comparison") > 0) | (ref > 1) | (kw > 1)
    pick = lambda route, sure, why: F.struct(F.lit(route).alias("route"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(F.rlike(query, F.lit(GREETING)), pick("chitchat", 1.0, "greeting"))
        .when((F.col("ambiguity_score") >= AMBIGUOUS) | F.col("has_pronoun"), pick("clarify", 0.7, "ambiguous"))
        .when(F.col("xdoc"), pick("hybrid_reasoning", 0.65, "cross_document"))
        .when(graph, pick("graph_traversal", 0.6, "multi_hop"))
        .otherwise(pick("dense_retrieval", 0.65, "default"))
    )


def graph_priority(route: Column, confidence: Column, p_graph: Column) -> Column:
    on = route.isin("dense_retrieval", "hybrid_reasoning") & (p_graph >= GRAPH_FLOOR) & (F.col("is_factoid_question") == 0) & ~F.col("xdoc") & (_c("lvl") >= 2)
    return F.struct(F.when(on, "graph_traversal").otherwise(route).alias("route"), F.when(on, F.greatest(p_graph, F.lit(GRAPH_CONFIDENCE))).otherwise(confidence).alias("confidence"))


def _cascade(*rules: tuple[Column, object, object]) -> Column:
    out = None
    for cond, allow, why in rules:
        v = F.struct((allow if isinstance(allow, Column) else F.lit(allow)).alias("allow"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


#: The reasons of the rules below are fixed values: logs are joined by them.


def ambiguity_override() -> Column:
    """May ambiguity turn the first stage's route into a clarification? allow, reason."""
    s, amb, hist = signals(), F.col("amb"), F.col("hist")
    resolved, unres = hist == "resolved", hist.isin(*UNRESOLVED, "unresolved")
    strong = (amb >= 0.95) & F.col("has_pronoun") & ~resolved
    base = _cascade(
        (F.col("ablation"), False, "ablation_no_severe_override_active"),
        (amb < 0.8, False, "ambiguity_below_clarify_threshold"),
        (resolved, False, "resolved_history_blocks_auto_clarify"),
        (s["relation_heavy"] & ~F.col("ctxref"), False, "blocked_auto_clarify_for_clear_relation_heavy_query"),
        (unres & F.col("ctxref"), True, F.concat(F.lit("override_to_clarify_"), hist)),
        ((F.col("missing_entity") | F.col("multi_interpretation") | F.col("incomplete_context")) & (amb >= AMBIGUOUS), True, "override_to_clarify_semantic_ambiguity"),
        (F.col("s1").isin("graph_traversal", "hybrid_reasoning") & strong, True, "extreme_unresolved_pronoun_on_reasoning_route"),
        (F.col("s1").isin("graph_traversal", "hybrid_reasoning"), False, "blocked_auto_clarify_for_reasoning_route"),
        ((F.col("s1") == "dense_retrieval") & strong & (F.col("c1") <= 0.65), True, "high_unresolved_pronoun_on_dense_route"),
        (F.col("s1") == "dense_retrieval", False, "blocked_auto_clarify_without_unresolved_pronoun"),
        (F.lit(True), False, "no_ambiguity_override_rule_matched"),
    )
    return base


def stage2_trigger(force: bool = True, threshold: float = LOW_CONFIDENCE) -> Column:
    """Is the second stage asked? invoke, reasons in order."""
    s, amb, c1, s1 = signals(), F.col("amb"), F.col("c1"), F.col("s1")
    strong = (_c("ref") >= 1) | (_c("kw") >= 1) | (_c("spec") >= 1) | (_c("auth") >= 1) | (_c("eff") >= 1)
    skip = (s1 == "dense_retrieval") & (c1 >= 0.95) & (amb <= 0.4) & ~strong
    rules = (
        ("low_confidence", c1 < threshold), ("ambiguous", F.col("is_ambiguous") & (amb >= AMBIGUOUS)),
        ("dense_with_strong_signal", F.lit(force) & (s1 == "dense_retrieval") & strong & ((c1 <= 0.90) | s["relation_heavy"])),
        ("reasoning_signal", F.lit(force) & s["reasoning"] & (c1 <= 0.90)), ("clarify_without_ambiguity", (s1 == "clarify") & (amb < AMBIGUOUS)),
        ("unresolved_reference", F.col("ctxref") & F.col("hist").isin(*UNRESOLVED)), ("no_reference", _c("ref") == 0),
    )
    reasons = F.when(skip, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))
    return F.struct((F.size(reasons) > 0).alias("invoke"), reasons.alias("reasons"))


def stage2_override() -> Column:
    """May the second stage's route replace the first's? Evaluated where they differ; allow, reason; denies by default."""
    s, amb, hist = signals(), F.col("amb"), F.col("hist")
    s1, s2, c2, ctx = F.col("s1"), F.col("s2"), F.col("c2"), F.col("ctxref")
    resolved, unres = (hist == "resolved") & F.col("has_referent"), hist.isin(*UNRESOLVED, "unresolved")
    severe = F.col("missing_entity") | F.col("multi_interpretation") | F.col("incomplete_context") | F.col("s2_missing_entity") | F.col("s2_pronoun") | F.col("s2_multi") | F.col("s2_incomplete")
    strong = (_c("auth") >= 1) | (_c("eff") >= 1) | (_c("proc") >= 1) | (_c("rel") >= 1) | (_c("kw") >= 2) | (F.col("mh") >= FORCE) | (F.col("s2_sub_questions") >= 2)
    wide, ask = F.col("xdoc") | (_c("ref") >= 2) | (_c("lvl") >= 3), s2 == "clarify"
    dense, graph, hybrid = "dense_retrieval", "graph_traversal", "hybrid_reasoning"
    nothing = (s1 == dense) & (_c("ref") == 0) & (_c("spec") == 0) & (_c("ent") == 0) & (F.col("missing_entity") | F.col("multi_interpretation"))
    return _cascade(
        ((s1 == "clarify") & resolved & ~ask & (c2 >= 0.80), True, "override_clarify_to_retrieval_resolved_history"),
        (~ask & (s2 == s1) & (c2 >= 0.82) & (~ctx | resolved | s["answerable"]), True, "restore_stage1_retrieval_after_stage2_confirmation"),
        (s1.isin(graph, hybrid) & (s2 == s1) & (c2 >= 0.80) & ~ctx, True, "restore_reasoning_route_after_ambiguity_candidate"),
        ((s1 == "clarify") & ~ask & (c2 >= 0.82) & (~ctx | s["answerable"]) & (s["relation_heavy"] | s["answerable"]), True, "override_clarify_to_relation_heavy_retrieval"),
        ((s1 == "clarify") & (s2 == dense) & (c2 >= 0.82) & ~severe & ~ctx, True, "override_clarify_to_dense_factoid"),
        (ask & resolved & ~(F.col("s2_missing_entity") | F.col("s2_multi") | F.col("s2_incomplete")), False, "resolved_history_blocks_unnecessary_clarify"),
        (ask & (c2 < 0.8), False, "stage2_clarify_below_threshold"),
        (ask & (hist == "conflicting_history"), True, "override_to_clarify_conflicting_history"),
        (ask & unres & ctx, True, "override_to_clarify_unresolved_history"),
        (ask & (amb >= AMBIGUOUS) & severe & F.col("ablation"), False, "ablation_no_severe_override_active"),
        (ask & (amb >= AMBIGUOUS) & severe & (F.col("s2_missing_entity") | F.col("missing_entity")), True, "override_to_clarify_missing_entity"),
        (ask & (amb >= AMBIGUOUS) & severe & (F.col("s2_multi") | F.col("multi_interpretation")), True, "override_to_clarify_multi_interpretation"),
        (ask & (amb >= AMBIGUOUS) & severe, True, "override_to_clarify_severe_ambiguity"),
        (ask & ctx & ~resolved, True, "override_to_clarify_unresolved_context_reference"),
        (ask & nothing, True, "override_to_clarify_dense_underspecified_target"),
        ((s1 == dense) & (s2 == graph) & (c2 >= 0.85) & strong, True, "rescue_dense_to_graph_strong_reasoning_signal"),
        ((s1 == graph) & (s2 == hybrid) & (c2 >= 0.88) & (wide | (_c("ref") == 0)), True, "rescue_graph_to_hybrid_cross_document_signal_or_ood"),
        ((s1 == dense) & (s2 == hybrid) & (c2 >= 0.82) & (wide | (_c("sq") >= 2) | (F.col("mh") >= 0.30) | (_c("kw") >= 2)), True, "rescue_dense_to_hybrid_strong_structural_signal"),
        (ask & (c2 >= 0.92) & (amb >= 0.75) & severe & ~F.col("ablation"), True, "rescue_to_clarify_severe_ambiguity"),
        ((s1 == dense) & (s2 == graph) & (c2 >= 0.82) & ((_c("ref") >= 1) | (_c("spec") >= 1)), True, "rescue_dense_to_graph_doc_specific_lookup"),
        (F.lit(True), False, "blocked_by_rescue_only_policy"),
    )


def guardrail() -> Column:
    """What the second stage's own answer is held to: route, whether it was blocked, and why. Its flags, complexity and
    questions are the second stage's (s2_...), not the features'."""
    s1, s2, c2, flag = F.col("s1"), F.col("s2"), F.col("c2"), F.col("s2_missing_entity") | F.col("s2_pronoun") | F.col("s2_multi") | F.col("s2_incomplete")
    dense, graph, hybrid, ask = "dense_retrieval", "graph_traversal", "hybrid_reasoning", "clarify"
    more = (F.col("s2_sub_questions") >= 2) | F.lower(F.trim("s2_complexity")).isin("complex", "moderate")
    rules = (
        ((s2 == ask) & ~F.col("s2_asks"), "clarify_without_question"),
        ((s1 == dense) & (s2 == graph) & ~((c2 >= 0.80) & more), "blocked_dense_to_graph_without_strong_multi_evidence"),
        ((s1 == graph) & (s2 == dense) & ~((c2 >= 0.85) & ~flag), "blocked_graph_to_dense_without_high_confidence_and_clean_ambiguity"),
        ((s1 == hybrid) & (s2 == graph) & ~((c2 >= 0.88) & ~flag), "blocked_hybrid_to_graph_without_high_confidence"),
        ((s1 == hybrid) & (s2 == ask) & ~((c2 >= 0.90) & (F.col("s2_missing_entity") | F.col("s2_pronoun") | F.col("s2_multi"))), "blocked_hybrid_to_clarify_without_severe_ambiguity"),
    )
    why = None
    for cond, reason in rules:
        why = F.when(cond, reason) if why is None else why.when(cond, reason)
    return F.struct(F.when(why.isNotNull(), s1).otherwise(s2).alias("route"), why.isNotNull().alias("blocked"), why.alias("reason"))


def factoid_rescue(route: Column, confidence: Column) -> Column:
    """A reasoning route of the first stage for a plain factoid goes back to dense retrieval: route, confidence."""
    plain = route.isin("graph_traversal", "hybrid_reasoning") & (F.col("is_factoid_question") > 0) & (_c("lvl") == 1) & (_c("cond") == 0) & (_c("auth") == 0)
    return F.struct(F.when(plain, "dense_retrieval").otherwise(route).alias("route"), F.when(plain, 0.99).otherwise(confidence).alias("confidence"))


def parse_fallback(parsed: Column) -> Column:
    """The second stage where its answer couldn't be parsed: the first stage's route at nine tenths of its confidence."""
    bad = ~F.coalesce(parsed, F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c1") * 0.9))
    return F.struct(F.when(bad, F.col("s1")).otherwise(F.col("s2")).alias("route"), F.when(bad, sure).otherwise(F.col("c2")).alias("confidence"), bad.alias("fell_back"))


def clarify_sanity(route: Column, referent: Column, needs_clarifying: Column) -> Column:
    """After the stages agree on a clarification: not where history named the referent and nothing else is open, and not
    where a first-stage route stands and the query holds what it takes. route, reason (null: as it was)."""
    named = (route == "clarify") & (F.col("hist") == "resolved") & ~needs_clarifying
    alone = (route == "clarify") & (F.col("s1") != "clarify") & (F.col("hist") == "no_history") & F.col("ctxref") & signals()["answerable"]
    why = F.when(named, "resolved_history_blocks_unnecessary_clarify").when(alone, "self_contained_query_blocks_unnecessary_clarify")
    return F.struct(F.when(named, resolved_route(referent)).when(alone, F.col("s1")).otherwise(route).alias("route"), why.alias("reason"))


def dispatch(route: Column, vector_informs: Column, graph_informs: Column, kg_source: Column) -> Column:
    """The pipeline that answers: dense retrieval falls back to the graph where its answer says nothing and the graph's
    does; an unknown route is dense retrieval."""
    dense = F.when(~vector_informs & graph_informs, "dense_retrieval->graph_traversal").otherwise("dense_retrieval")
    hybrid = F.when(F.coalesce(kg_source, F.lit("")) != "", F.concat(F.lit("hybrid_reasoning:"), kg_source)).otherwise("hybrid_reasoning")
    return F.when(route == "dense_retrieval", dense).when(route == "hybrid_reasoning", hybrid).when(route.isin("graph_traversal", "clarify", "chitchat"), route).otherwise("dense_retrieval")


def resolved_route(referent: Column) -> Column:
    s = signals()
    wide = F.col("xdoc") | (_c("ref") >= 2) | (_c("lvl") >= 3) | (_c("sq") >= 2)
    named = F.rlike(F.coalesce(referent, F.lit("")), F.lit(r"(?iuU)nghị định|quyết định|thông tư|luật|/"))
    return F.when(s["relation_heavy"], F.when(wide, "hybrid_reasoning").otherwise("graph_traversal")).when(F.col("ctxref") & named, "graph_traversal").otherwise("dense_retrieval")


def first_evidence(df: DataFrame, query_id: str, priority: str, source: str) -> DataFrame:
    """Of the evidence of several paths, that of each query's first path that found any, with its source as kg_source."""
    first = df.groupBy(query_id).agg(F.min(F.struct(priority, source)).alias("_first"))
    return df.join(first, query_id).where(F.col(priority) == F.col("_first")[priority]).withColumn("kg_source", F.col("_first")[source]).drop("_first")


#: The patterns of the two baselines that learn nothing.
KEYWORDS = {"hybrid_reasoning": r"\b(nhiều|tổng hợp|đồng thời|kết hợp|cả hai|các văn bản|cross)\b", "graph_traversal": r"\b(quan hệ|liên quan|giữa|so sánh|khác nhau|ảnh hưởng|tác động|dẫn đến)\b"}
THREE_RULES = {
    "clarify": r"\b(ông ấy|bà ấy|họ|nó|người đó|điều đó|luật đó)\b", "hybrid_reasoning": r"\b(nhiều văn bản|các luật|cả hai|đồng thời|kết hợp)\b", "graph_traversal": r"\b(sau khi|khi nào|nếu|liên quan đến|so với|giữa)\b",
}


def pattern_baseline(query: Column, rules: dict[str, str], known: tuple[str, ...] | None = None) -> Column:
    """The route of the first rule whose pattern the query has, else dense retrieval. known: the routes that training rows had; a route
    that isn't among them becomes dense retrieval, or the first known one."""
    least = "dense_retrieval" if known is None or "dense_retrieval" in known else known[0]
    out = F.lit(least)
    for route, pattern in reversed(rules.items()):
        out = F.when(F.rlike(query, F.lit("(?iuU)" + pattern)), route if known is None or route in known else "dense_retrieval").otherwise(out)
    return out


def labelled(df: DataFrame, routes: tuple[str, ...] = ("dense_retrieval", "graph_traversal", "hybrid_reasoning", "clarify")) -> DataFrame:
    """Rows of a question and a known label, both trimmed."""
    q, y = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("routing_label", F.lit("")))
    return df.withColumns({"question": q, "routing_label": y}).where((F.col("question") != "") & F.col("routing_label").isin(*routes))


def run_routes(df: DataFrame, pipelines: dict, uninformative) -> DataFrame:
    """df: query_id, route and what the pipelines read. query_id, answer, pipeline, kg_source.

    pipelines: route -> function of df that gives query_id, answer, kg_source (of the graph and hybrid ones), one row a query at most. Each
    runs once, over the queries of its route and those that fall back to it: dense answers that say nothing go to the graph, whose
    answer counts if it says more; graph answers that say nothing, or none at all, are answered by dense retrieval. An
    unknown route is dense retrieval. uninformative: a column function of the answer."""
    none = F.coalesce(uninformative(F.col("answer")), F.lit(True)) | F.col("answer").isNull()
    known = ("graph_traversal", "hybrid_reasoning", *(r for r in pipelines if r not in ("dense_retrieval", "graph_traversal", "hybrid_reasoning")))
    rows = df.withColumn("route", F.when(F.col("route").isin(*known), F.col("route")).otherwise("dense_retrieval"))
    of = lambda route: rows.where(F.col("route") == route)

    def answers(route: str, asked: DataFrame, prefix: str) -> DataFrame:
        a = pipelines[route](asked).select(F.col("query_id").alias("_q"), F.col("answer"), *([F.col("kg_source")] if route != "dense_retrieval" else [F.lit("").alias("kg_source")]))
        x = asked.select("query_id").join(a, F.col("query_id") == F.col("_q"), "left").withColumn("bad", none)
        return x.select("query_id", *(F.col(c).alias(prefix + c) for c in ("answer", "kg_source", "bad")))

    dense = storage.cut(answers("dense_retrieval", of("dense_retrieval"), ""), "dense")
    to_graph = of("graph_traversal").withColumn("_from", F.lit("graph")).unionByName(rows.join(dense.where("bad").select("query_id"), "query_id", "left_semi").withColumn("_from", F.lit("dense")).select(*rows.columns, "_from"))
    graph = storage.cut(answers("graph_traversal", to_graph.drop("_from"), "g_").join(to_graph.select("query_id", "_from"), "query_id"), "graph")
    again = rows.join(graph.where("g_bad").select("query_id"), "query_id", "left_semi").select(rows.columns)
    second = storage.cut(answers("dense_retrieval", again, "v_"), "again")
    kg = F.coalesce("g_kg_source", F.lit(""))
    g = graph.join(second.select("query_id", "v_answer", "v_bad"), "query_id", "left")
    g = g.select(
        "query_id", "_from", F.when(F.col("g_bad"), F.col("v_answer")).otherwise(F.col("g_answer")).alias("answer"), F.when(F.col("g_bad"), F.coalesce("v_bad", F.lit(True))).otherwise(False).alias("bad"),
        F.when(F.col("g_bad"), F.when(kg != "", F.concat(F.lit("graph_traversal:"), kg, F.lit("->dense_retrieval"))).otherwise("dense_retrieval")).otherwise(F.when(kg != "", F.concat(F.lit("graph_traversal:"), kg)).otherwise("graph_traversal")).alias("pipeline"),
        F.when(F.col("g_bad"), F.when(kg != "", F.concat(kg, F.lit("->vector"))).otherwise("vector")).otherwise(kg).alias("kg_source"),
    )
    out = g.where("_from = 'graph'").select("query_id", "answer", "pipeline", "kg_source")
    better = g.where("_from = 'dense' and not bad").select("query_id", F.col("answer").alias("b_answer"), F.concat(F.lit("dense_retrieval->"), "pipeline").alias("b_pipeline"), F.col("kg_source").alias("b_kg"))
    d = dense.join(better, "query_id", "left")
    out = out.unionByName(d.select("query_id", F.coalesce("b_answer", "answer").alias("answer"), F.coalesce("b_pipeline", F.lit("dense_retrieval")).alias("pipeline"), F.coalesce("b_kg", F.lit("")).alias("kg_source")))
    for route in known[1:]:
        x = answers(route, of(route), "")
        name = F.when((F.lit(route) == "hybrid_reasoning") & (F.coalesce("kg_source", F.lit("")) != ""), F.concat(F.lit("hybrid_reasoning:"), "kg_source")).otherwise(route)
        out = out.unionByName(x.select("query_id", "answer", name.alias("pipeline"), F.coalesce("kg_source", F.lit("")).alias("kg_source")))
    return out
