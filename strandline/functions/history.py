"""What a query's references mean in its history.

Candidates carry offsets, and containment dedup is a sequential rule, so a batch is resolved in one Arrow UDF; the
status rules after it work on a handful of candidates a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import patterns as P

CANDIDATE = T.StructType().add("text", "string").add("type", "string").add("source_span", "string").add("confidence", "double")
RESULT = (
    T.StructType().add("has_history", "boolean").add("query_has_contextual_reference", "boolean").add("candidates", T.ArrayType(CANDIDATE))
    .add("resolved_referent", "string").add("status", "string").add("confidence", "double").add("reason", "string")
)
#: Types to look among when none of the likely ones is there, by the likely type.
FALLBACK = (
    ("legal_article", {"legal_document", "concept", "procedure"}),
    ("procedure", {"procedure", "concept", "legal_document", "factual_situation"}),
    ("factual_situation", {"concept", "procedure", "legal_document"}),
)
_flags = re.IGNORECASE
_referents = [(t, c, re.compile(p, _flags) if p else None) for t, c, p in P.REFERENTS]
_contextual = [(re.compile(p, _flags), types) for p, types in P.CONTEXTUAL]
_demonstrative = re.compile(P.DEMONSTRATIVE, _flags)


def likely_types(query: str) -> list[str]:
    return list(dict.fromkeys(t for p, types in _contextual if p.search(query) for t in types))


def _norm(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(" .,:;()[]").lower()


def distinct(found: list[tuple]) -> list[tuple]:
    """Of one type, what contains another (both of 8 letters or more) or equals it goes after the surer one."""
    kept: list[tuple] = []
    for c in sorted(found, key=lambda x: (-x[3], x[2])):
        n = _norm(c[0])
        same = ((n, _norm(k[0])) for k in kept if k[1] == c[1])
        if not any(a == b or (min(len(a), len(b)) >= 8 and (a in b or b in a)) for a, b in same):
            kept.append(c)
    return kept


def candidates(history: str) -> list[tuple]:
    """(text, type, span, confidence) of what a history names."""
    found = []
    for kind, sure, pattern in _referents:
        if pattern is None:
            low = history.lower()
            for phrase in P.CONCEPTS:
                at = low.find(phrase)
                if at >= 0:
                    found.append((history[at : at + len(phrase)], kind, f"history[{at}:{at + len(phrase)}]", sure))
            continue
        for m in pattern.finditer(history):
            value = re.sub(r"\s+", " ", m[0]).strip(" .,:;()[]")
            if len(value) >= 4 and not any(x in value.lower() for x in P.NO_REFERENT):
                found.append((value, kind, f"history[{m.start()}:{m.end()}]", sure))
    return distinct(found)


def _relevant(found: list[tuple], likely: list[str]) -> list[tuple]:
    own = [c for c in found if c[1] in likely]
    if own:
        return own
    for kind, types in FALLBACK:
        other = [c for c in found if c[1] in types] if kind in likely else []
        if other:
            return other
    return []


def resolve(query: str | None, history: str | None) -> tuple:
    """The fields of RESULT for one query."""
    q, h = (query or "").strip(), (history or "").strip()
    likely = likely_types(q)
    found = candidates(h) if h else []
    if not likely:
        return bool(h), False, found, None, "not_needed", 0.0, "query_does_not_require_history"
    if not h:
        return False, True, [], None, "no_history", 0.0, "query_has_contextual_reference_but_history_is_empty"
    if not found:
        return True, True, [], None, "irrelevant_history", 0.0, "history_has_no_strong_legal_referent"
    pool = _relevant(found, likely)
    if not pool:
        return True, True, found, None, "irrelevant_history", max(c[3] for c in found), "history_referents_do_not_match_query_reference_type"
    primary = distinct([c for c in pool if c[1] == likely[0]])
    if not primary:
        groups: dict[str, list] = {}
        for c in distinct(pool):
            groups.setdefault(c[1], []).append(c)
        several = [g for g in groups.values() if len(g) > 1]
        primary = max(several, key=lambda g: (len(g), max(c[3] for c in g))) if several else []
    if len(primary) > 1 and _demonstrative.search(q):
        return True, True, found, None, "conflicting_history", max(c[3] for c in primary), "multiple_strong_candidates_for_singular_reference"
    best = max(primary or pool, key=lambda c: c[3])
    return True, True, found, best[0], "resolved", best[3], f"resolved_to_single_{best[1]}"


@F.pandas_udf(RESULT)
def _resolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for q, h in parts:
        rows = [resolve(a, b) for a, b in zip(q, h)]
        yield pd.DataFrame([(r[0], r[1], [dict(zip(("text", "type", "source_span", "confidence"), c)) for c in r[2]], *r[3:]) for r in rows], columns=RESULT.names)


def with_history(df: DataFrame, query: str = "query", history: str = "history") -> DataFrame:
    """df with the struct `resolution`, history_resolution_status and query_has_contextual_reference."""
    r = df.withColumn("resolution", _resolve(F.col(query), F.col(history)))
    return r.withColumn("history_resolution_status", F.col("resolution.status")).withColumn("query_has_contextual_reference", F.col("resolution.query_has_contextual_reference"))
