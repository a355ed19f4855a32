"""Scalar text functions as column expressions. Patterns are matched as Python's re.I does on Unicode text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuU)"
#: White space that str.strip and str.split know, beyond what trim() does.
_WS = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Words between white space; none in empty text."""
    return F.filter(F.split(c, _WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(FLAGS + pattern))


def any_of(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [matches(c, p) for p in patterns])


def pattern_count(c: Column, patterns) -> Column:
    """How many patterns match, not how often."""
    return reduce(lambda a, b: a + b, [matches(c, p).cast("int") for p in patterns])


def occurrences(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(FLAGS + pattern))


def distinct_matches(c: Column, patterns) -> Column:
    """Number of different matches of all patterns, trimmed, in lower case."""
    found = F.concat(*[F.transform(F.regexp_extract_all(c, F.lit(FLAGS + p), F.lit(0)), lambda x: F.lower(strip(x))) for p in patterns])
    return F.size(F.array_distinct(found))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), _WS, " ")


def parse_key(c: Column) -> Column:
    """`DOC::ARTICLE`, split once; without a mark all of it is the law and the article is empty."""
    p = F.split(c, "::", 2)
    return F.struct(p[0].alias("law_id"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("article_id"))


def canonical_id(c: Column) -> Column:
    """Law and article that a question names, as `LAW::article`; null if it names none."""
    pattern = r"Điều\s+(\S+)\s+của\s+văn\s+bản\s+(\d+\s*/\s*\d{4}\s*/\s*[A-ZĐ0-9\-]+)"
    article, law = F.regexp_extract(c, FLAGS + pattern, 1), F.regexp_extract(c, FLAGS + pattern, 2)
    return F.when(article != "", F.concat(F.upper(F.regexp_replace(law, r"\s+", "")), F.lit("::"), F.lower(article)))


def truncated(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def looks_truncated(c: Column) -> Column:
    """Non-empty and without a closing mark at its end."""
    t = strip(c)
    return (t != "") & ~F.rlike(t, F.lit(r"""[.!?"')\]]$"""))


def repair_json(c: Column) -> Column:
    """A JSON object out of a model's answer: thought and code fences go, trailing commas and Python's constants are
    put right, and what stands outside the outermost braces is left out."""
    x = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    x = F.regexp_replace(x, r"```(?:json)?", "")
    x = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    x = F.regexp_replace(x, r",\s*([}\]])", "$1")
    for a, b in (("True", "true"), ("False", "false"), ("None", "null")):
        x = F.regexp_replace(x, rf"(?<=[:\[,\s]){a}(?=[,\]}}\s])", b)
    return F.when(x != "", x)


def clamp(c: Column, default: float = 0.0) -> Column:
    """A string or number as a share of one; the default if it is no number."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def null_if_nullish(c: Column) -> Column:
    t = strip(c)
    return F.when(~F.lower(t).isin("", "null"), t)


def session_title(c: Column) -> Column:
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 50), F.lit("..."))).otherwise(c)


def max_tokens(content: Column) -> Column:
    n = F.length(content)
    return F.when(n < 500, 500).when(n < 2000, 1500).otherwise(3000)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
