"""Ambiguity of a query: six checks, their scores, and the question to ask back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import patterns as P
from strandline.functions import text as T

THRESHOLD = 0.6
TYPES = ("pronoun", "pronoun_reference", "vague_reference", "missing_entity", "multi_interpretation", "incomplete_context", "entity_conflict")


def first_pronoun(q: Column, pronouns=P.PRONOUNS) -> Column:
    """The name of the first pattern that matches; null without one."""
    return F.coalesce(*[F.when(T.matches(q, p), F.lit(name)) for name, p in pronouns])


def pronoun_score(pronoun: Column, status: Column, has_history: Column) -> Column:
    by_status = F.when(status == "resolved", 0.0).when(status.isin("no_history", "conflicting_history"), 0.9).when(status == "irrelevant_history", 0.85)
    return F.when(pronoun.isNull(), 0.0).otherwise(F.coalesce(by_status, F.when(has_history, 0.7).otherwise(0.9)))


def vague_score(q: Column, custom=()) -> Column:
    n = sum((T.occurrences(q, p) for p in P.VAGUE), F.lit(0))
    if custom:
        own = sum((F.contains(F.lower(q), F.lit(w.lower())).cast("int") for w in custom), F.lit(0))
        n = n + F.when(T.matches(q, P.SPECIFIC_ENTITY), 0).otherwise(own)
    return F.least(F.lit(1.0), F.round(n * 0.3, 6))


def has_entity(q: Column) -> Column:
    return T.any_of(q, [p for _, p in P.ENTITIES]) | T.matches(q, P.NAMED_DOCUMENT)


def topics(q: Column) -> Column:
    low = F.lower(q)
    found = []
    for name, keys in P.TOPICS.items():
        cond = F.lit(False)
        for k in keys:
            cond = cond | F.contains(low, F.lit(k))
        found.append(F.when(cond, F.lit(name)))
    return F.array_compact(F.array(*found))


def missing_score(q: Column, intent: Column) -> tuple[Column, Column]:
    """Score, and the type of what is missing."""
    known, n = has_entity(q), T.word_count(q)
    generic = T.matches(q, P.GENERIC_NEED) & ~(known | T.matches(q, P.CONCRETE_ANCHOR))
    score = F.when(generic, 0.82).when(known, 0.0).when(n < 5, 0.7).when(n < 10, F.when(intent, 0.1).otherwise(0.3)).otherwise(F.when(intent, 0.05).otherwise(0.2))
    return score, F.when(generic, "LEGAL_TARGET").when(~known, "LEGAL_ARTICLE")


def multi_score(q: Column) -> Column:
    wide = T.matches(q, P.BROAD_PREDICATE) & ~T.matches(q, P.DOMAIN_ANCHOR)
    return F.when(wide & T.matches(q, P.BROAD_SUBJECT), 0.85).when(wide & (T.word_count(q) <= 7), 0.75).otherwise(0.0)


def incomplete_score(contextual: Column, status: Column) -> Column:
    return F.when(~contextual, 0.0).when(status.isin("no_history", "conflicting_history"), 0.9).when(status == "irrelevant_history", 0.85).otherwise(0.0)


def conflict_score(q: Column) -> Column:
    n = F.lit(0)
    for _, p in P.ENTITIES:
        k = T.occurrences(q, p)
        n = n + F.when(k > 1, k).otherwise(0)
    return F.when(T.matches(q, P.COMPARES), 0.0).otherwise(F.least(F.lit(0.5), F.round(n * 0.15, 6)))


def detect(df: DataFrame, query: str = "query", history: str | None = None, custom_vague=()) -> DataFrame:
    """df, with history_resolution_status and query_has_contextual_reference if it was resolved against a history, with
    a struct `ambiguity`: the scores, the types in order, the primary type, and the question to ask."""
    q = F.coalesce(F.col(query), F.lit(""))
    has = F.coalesce(F.length(T.strip(F.col(history))) > 0, F.lit(False)) if history else F.lit(False)
    status = F.col("history_resolution_status") if "history_resolution_status" in df.columns else F.lit(None).cast("string")
    contextual = F.col("query_has_contextual_reference") if "query_has_contextual_reference" in df.columns else F.lit(False)
    df = df.withColumns({"_topics": topics(q), "_pronoun": first_pronoun(q), "_status": status, "_ctx": contextual})
    missing, kind = missing_score(q, F.size("_topics") > 0)
    df = df.withColumns(
        {
            "_p": pronoun_score(F.col("_pronoun"), F.col("_status"), has), "_v": vague_score(q, custom_vague), "_m": missing, "_kind": kind,
            "_x": multi_score(q), "_i": incomplete_score(F.col("_ctx"), F.col("_status")), "_c": conflict_score(q),
        }
    )
    on = {"pronoun": "_p", "pronoun_reference": "_p", "vague_reference": "_v", "missing_entity": "_m", "multi_interpretation": "_x", "incomplete_context": "_i", "entity_conflict": "_c"}
    types = F.array_compact(F.array(*[F.when(F.col(on[t]) > 0, F.lit(t)) for t in TYPES]))
    primary = F.coalesce(*[F.when(F.col(on[t]) > 0, F.lit(t)) for t in TYPES if t not in ("pronoun_reference", "entity_conflict")], F.lit("general"))
    score = F.greatest("_p", "_v", "_m", "_x", "_i", "_c")
    name = F.coalesce(*[F.when(F.col("_kind") == k, F.lit(v)) for k, v in P.ENTITY_NAMES.items()], F.col("_kind"))
    ask = (
        F.when(F.col("_p") > 0, F.replace(F.lit(P.CLARIFY["pronoun"]), F.lit("{pronoun}"), F.col("_pronoun")))
        .when(F.col("_v") > 0, P.CLARIFY["vague_reference"]).when(F.col("_i") > 0, P.CLARIFY["incomplete_context"])
        .when(F.col("_m") > 0, F.replace(F.lit(P.CLARIFY["missing_entity"]), F.lit("{entity_type}"), name))
        .when(F.col("_c") > 0, P.CLARIFY["entity_conflict"]).when(F.col("_x") > 0, P.CLARIFY["multi_interpretation"]).otherwise(P.CLARIFY["general"])
    )
    report = F.struct(
        score.alias("score"), (score >= THRESHOLD).alias("is_ambiguous"), types.alias("types"), primary.alias("primary"), F.col("_pronoun").alias("pronoun"),
        F.col("_kind").alias("missing_entity_type"), F.greatest("_m", "_x").alias("semantic_score"), F.col("_topics").alias("topics"),
        F.when(score >= THRESHOLD, ask).alias("clarification"), F.when(F.col("_status") == "resolved", 0.0).otherwise(score).alias("formal_score"),
    )
    return df.withColumn("ambiguity", report).drop("_topics", "_pronoun", "_status", "_ctx", "_p", "_v", "_m", "_kind", "_x", "_i", "_c")
