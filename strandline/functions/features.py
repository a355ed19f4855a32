"""The 27 features of a query, and the scores derived from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import patterns as P
from strandline.functions import text as T

LEXICAL = (
    "query_length_chars", "query_length_words", "graph_keyword_count", "legal_reference_count", "dieu_reference_count", "multi_article_ref",
    "is_yes_no_question", "is_factoid_question", "cross_doc_signal_count", "has_conditional_structure", "has_negation", "has_comparison",
    "has_enumeration", "has_procedure_marker", "ambiguity_score", "has_multi_hop_connector",
)
REASONING = (
    "complexity_level", "sub_question_count", "law_specificity", "conditional_depth", "multi_hop_verb_count", "comparative_depth",
    "authority_chain_count", "legal_effect_count", "procedural_count", "multi_entity_relation_count", "entity_count",
)
ALL = LEXICAL + REASONING


def lexical(q: Column, bank: P.Lexical | None = None) -> dict[str, Column]:
    bank, t = bank or P.Lexical(), T.strip(q)
    refs = T.occurrences(t, bank.article_ref)
    return {
        "query_length_chars": F.length(t), "query_length_words": T.word_count(t), "graph_keyword_count": T.pattern_count(t, bank.graph_keywords),
        "legal_reference_count": T.distinct_matches(t, bank.legal_refs), "dieu_reference_count": refs, "multi_article_ref": (refs >= 2).cast("int"),
        "is_yes_no_question": T.any_of(t, bank.yes_no).cast("int"), "is_factoid_question": T.any_of(t, bank.factoid).cast("int"),
        "cross_doc_signal_count": T.pattern_count(t, bank.cross_doc),
        **{k: T.matches(t, bank.structure[k]).cast("int") for k in LEXICAL if k in bank.structure},
        "ambiguity_score": T.pattern_count(t, bank.ambiguity),
    }


def with_features(df: DataFrame, query: str = "query", bank: P.Lexical | None = None, complexity: P.Complexity = P.VI) -> DataFrame:
    """df with the 27 features and entity_density, is_factoid, multi_hop_score. Null queries count as empty.

    Counts come first and the level after them, so each pattern is matched once."""
    q = F.coalesce(F.col(query), F.lit(""))
    b = complexity
    df = df.withColumns(lexical(q, bank))
    count = lambda p: T.occurrences(q, p) if p else F.lit(0)
    df = df.withColumns(
        {
            "_sub": count(b.sub_question), "_articles": count(b.article), "_laws": count(b.law_name), "conditional_depth": count(b.conditional),
            "is_factoid": T.matches(q, b.factoid), "multi_hop_verb_count": count(b.multi_hop), "comparative_depth": count(b.comparative),
            "_authority": count(b.authority), "legal_effect_count": count(b.effect), "_strong": count(b.strong_effect), "_procedural": count(b.procedural),
            "_relation": count(b.relation), "_date": T.matches(q, b.effective_date), "_org": count(b.organisation), "_quantity": count(b.quantity),
            "_finance": count(b.finance), "entity_count": count(b.entity), "_tokens": F.greatest(T.word_count(q), F.lit(1)),
        }
    )
    c = F.col
    many, funds = c("_quantity") >= 2, (c("_finance") >= 2) & (c("conditional_depth") >= 1)
    df = df.withColumns(
        {
            "sub_question_count": F.when(many | funds, F.greatest(c("_sub"), F.lit(1))).otherwise(c("_sub")),
            "law_specificity": F.when(c("_articles") > 0, 2).when(c("_laws") > 0, 1).otherwise(0),
            "authority_chain_count": c("_authority") + c("_org"),
            "procedural_count": c("_procedural") + c("_finance"),
            "multi_entity_relation_count": c("_relation") + (c("_org") >= 2).cast("int") + many.cast("int"),
            "entity_density": F.round(c("entity_count") / c("_tokens"), 4),
        }
    )
    sq, mhv, cond, laws, art, tok = (c(x) for x in ("sub_question_count", "multi_hop_verb_count", "conditional_depth", "_laws", "_articles", "_tokens"))
    auth, eff, strong, proc, rel = (c(x) for x in ("authority_chain_count", "legal_effect_count", "_strong", "procedural_count", "multi_entity_relation_count"))
    three = (laws >= 2) | (mhv >= 2) | (strong >= 2) | ((cond >= 2) & (laws >= 1)) | ((sq >= 3) & (art == 0)) | ((rel >= 1) & (laws >= 2))
    plain = c("_date") & (strong == 0) & (auth == 0) & (rel == 0) & (sq == 0) & (proc <= 1)
    two = (
        ((art >= 2) & (sq >= 1)) | (mhv >= 1) | (c("comparative_depth") >= 1) | ((tok > 20) & (art >= 1) & (sq >= 1))
        | ((auth >= 1) & ((sq >= 1) | (tok > 12) | (art >= 1))) | (strong >= 1) | ((eff >= 1) & ((sq >= 1) | (cond >= 1) | (art >= 1)))
        | (proc >= 2) | ((proc >= 1) & ((sq >= 1) | (auth >= 1) | (tok > 20) | (cond >= 1))) | (rel >= 1)
    )
    df = df.withColumn("complexity_level", F.when(three, 3).when(plain, 1).when(two, 2).otherwise(1))
    score = F.least(F.lit(1.0), (c("graph_keyword_count") + mhv + c("has_multi_hop_connector") + sq) / 3)
    df = df.withColumn("multi_hop_score", score)
    return df.drop("_sub", "_articles", "_laws", "_authority", "_strong", "_procedural", "_relation", "_date", "_org", "_quantity", "_finance", "_tokens")


def vector(df: DataFrame, names=ALL) -> DataFrame:
    """df with a column features; names that df lacks count as 0."""
    return df.withColumn("features", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in names]))


def question_type(q: Column) -> Column:
    t = T.strip(F.lower(q))
    out = None
    for name, found in P.QUESTION_TYPES:
        cond = None
        for p in found:
            m = F.rlike(t, F.lit("(?uU)" + p))
            cond = m if cond is None else cond | m
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("factoid")


def has_reasoning(q: Column) -> Column:
    t = F.lower(q)
    cond = F.lit(False)
    for w in P.REASONING:
        cond = cond | F.contains(t, F.lit(w))
    return cond


def level_hint(level: Column) -> Column:
    return F.when(level == 2, "graph_traversal").when(level == 3, "hybrid_reasoning").otherwise("dense_retrieval")
