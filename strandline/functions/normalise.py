"""Normal forms of names, labels and references, and predicates on answers, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions import text as T

# Phrases and markers that results depend on.
UNINFORMATIVE = (
    "không có thông tin",
    "không tìm thấy",
    "không có căn cứ",
    "không đủ thông tin",
    "không có trong ngữ cảnh",
    "không được đề cập trong ngữ cảnh",
    "không được nêu cụ thể",
    "không nêu cụ thể",
    "không xác định",
    "no relevant information",
    "not enough information",
)
STREAM_TRIGGERS = ("không tìm thấy", "không có", "không được đề cập", "không đủ thông tin", "không xác định")
RETRYABLE = ("429", "too many requests", "rate limit", "rate_limit", "quota", "overloaded", "503", "502", "timeout", "connection")
ERROR_PREDICTIONS = ("Lỗi khi tạo câu trả lời:", "Lỗi khi tổng hợp câu trả lời", "OpenAI generation failed", "HTTP 429", "Too Many Requests")
DOC_NUMBER = r"\b(\d{1,4}/\d{4}/[A-ZĐa-z][A-ZĐa-z\-/]{1,25})\b"
ARTICLE_NUMBER = r"(?iu)Điều\s+(\d+)"
LUCENE_SPECIAL = r'([\\+\-!(){}\[\]^"~*?:/])'
#: Least lengths of contents, by what they are for.
CONTENT_GATES = {"benchmark": 80, "graph": 20, "vector": 50, "extraction": 20}


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """Composed letters, runs of white space as one blank, none at the ends."""
    return T.strip(F.regexp_replace(_composed(c), r"(?U)\s+", " "))


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """A name in lower case with single blanks, then what the alias map has for it."""
    key = F.lower(T.strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    if not aliases:
        return key
    known = F.create_map(*(F.lit(x) for kv in sorted(aliases.items()) for x in kv))
    return F.coalesce(F.try_element_at(known, key), key)


def article_label(c: Column) -> Column:
    """Internal numbered ids as `Điều N[. title]`; any other label as it is."""
    t = T.strip(c)
    body = F.when(F.rlike(t, F.lit(r"^(?:[\d.]+\.\s*)?Điều\s+.*$")), F.regexp_extract(t, r"^(?:[\d.]+\.\s*)?Điều\s+(.*)$", 1)).otherwise(t)
    out = c
    for pattern in (r"^[\d.]+\.[A-ZĐ]+\.(\d+)\.\s*(.*)$", r"^[\d.]+\.[A-ZĐ]+\.\d+\.(\d+)\.\s*(.*)$"):  # the last one goes first
        title = T.strip(F.regexp_extract(body, pattern, 2))
        out = F.when(F.rlike(body, F.lit(pattern)), F.concat(F.lit("Điều "), F.regexp_extract(body, pattern, 1), F.when(title != "", F.concat(F.lit(". "), title)).otherwise(""))).otherwise(out)
    return out


def evidence_parts(c: Column) -> Column:
    """Evidence cut before each line that begins an article: array of (content, article), blank parts left out."""
    parts = F.filter(F.transform(F.split(c, r"\n(?=Điều\s+\d+[\.\s])"), T.strip), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(x.alias("content"), T.strip(F.regexp_extract(x, r"^(Điều\s+\d+[\.\s]?)", 1)).alias("article")))


def doc_numbers(c: Column) -> Column:
    """Document numbers of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(DOC_NUMBER), F.lit(1)))


def article_numbers(c: Column) -> Column:
    """Article numbers of a text, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ARTICLE_NUMBER), F.lit(1)), lambda x: x.cast("int")))


def full_text_query(terms: Column, most: int = 8) -> Column:
    """Quoted terms joined by OR, with what the query language reserves escaped."""
    clean = F.transform(F.slice(terms, 1, most), lambda x: T.strip(F.regexp_replace(x, LUCENE_SPECIAL, r"\\$1")))
    return F.array_join(F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def _any(c: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def uninformative(answer: Column) -> Column:
    """Whether an answer says that its context held no evidence."""
    return F.coalesce(_any(F.lower(F.regexp_replace(answer, r"(?U)\s+", " ")), UNINFORMATIVE), F.lit(False))


def stream_falls_back(answer: Column, head: int = 50) -> Column:
    """Whether a streamed answer's beginning, up to what is held back, calls for the fallback."""
    return F.coalesce(_any(F.lower(F.substring(answer, 1, head + 1)), STREAM_TRIGGERS), F.lit(False))


def retryable(message: Column) -> Column:
    return F.coalesce(_any(F.lower(message), RETRYABLE), F.lit(False))


def error_prediction(answer: Column) -> Column:
    return F.coalesce(_any(answer, ERROR_PREDICTIONS), F.lit(False))


def long_enough(content: Column, use: str) -> Column:
    return F.coalesce(F.length(T.strip(content)), F.lit(0)) >= CONTENT_GATES[use]
