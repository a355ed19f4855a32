"""Named terms by rule, overlaps resolved, as arrays of structs. Offsets need matches in order, so it is an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.ArrayType(T.StructType().add("text", "string").add("label", "string").add("start", "integer").add("end", "integer").add("confidence", "double"))
#: Fixed values: (label, confidence, pattern, ignores case), in order of precedence.
VI = (
    ("LEGAL_TERM", 0.95, r"Điều\s+\d+[a-zđ]?", True), ("LEGAL_TERM", 0.95, r"Khoản\s+\d+", True), ("LEGAL_TERM", 0.95, r"Điểm\s+[a-zđ]", True),
    ("LEGAL_TERM", 0.95, r"(?:Bộ\s+luật|Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định|Nghị\s+quyết)\s+(?:số\s+)?\d*[^,.\n]{0,80}", True),
    ("LEGAL_TERM", 0.95, r"(?:Bộ\s+luật|Luật)\s+[A-ZĐÀÁẢÃẠÈÉẺẼẸÌÍỈĨỊÒÓỎÕỌÙÚỦŨỤỲÝỶỸỴÂĂÊÔƠƯa-zđàáảãạèéẻẽẹìíỉĩịòóỏõọùúủũụỳýỷỹỵâăêôơư][^,.\n]{0,60}", False),
)
QUOTED = (("MISC", 0.90, r'"([^"\n]{2,80})"', True),)


def find(text: str | None, rules=VI) -> list[dict]:
    """Greedy by rule: a match that overlaps one of an earlier rule is left out."""
    taken: list[tuple[int, int]] = []
    out = []
    for label, sure, pattern, fold in rules:
        for m in re.finditer(pattern, text or "", re.I if fold else 0):
            s, e = m.span()
            if not any(a <= s < b or a < e <= b for a, b in taken):
                taken.append((s, e))
                out.append({"text": (m[1] if m.lastindex else m[0]).strip(), "label": label, "start": s, "end": e, "confidence": sure})
    return out


def resolve(found: list[dict]) -> list[dict]:
    """In order of start, the surer one of two that overlap."""
    out: list[dict] = []
    for x in sorted(found, key=lambda x: (x["start"], -x["confidence"])):
        if out and x["start"] < out[-1]["end"]:
            if x["confidence"] > out[-1]["confidence"]:
                out[-1] = x
        else:
            out.append(x)
    return out


def entities(*banks):
    """A column function: the entities of all banks, overlaps resolved."""

    @F.pandas_udf(ENTITY)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: resolve([x for b in banks or (VI,) for x in find(t, b)]))

    return run
