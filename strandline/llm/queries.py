"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from strandline.llm import exact, mixing, spelling, vectorcodes
from strandline.llm.exact import op10_exact
from strandline.llm.flatgraph import op9_flatgraph
from strandline.llm.langid import op4_langid
from strandline.llm.mixing import op7_mixing
from strandline.llm.minhash import op6_minhash
from strandline.llm.pieces import op8_pieces
from strandline.llm.pii import op3_pii
from strandline.llm.quality import op1_quality
from strandline.llm.rules import op13_rules
from strandline.llm.spelling import op12_spelling
from strandline.llm.suffix import op5_suffix
from strandline.llm.toxicity import op2_toxicity
from strandline.llm.vectorcodes import op11_codes

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_langid": op4_langid,
    "op5_suffix": op5_suffix,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_pieces": op8_pieces,
    "op9_flatgraph": op9_flatgraph,
    "op10_exact": op10_exact,
    "op11_codes": op11_codes,
    "op12_spelling": op12_spelling,
    "op13_rules": op13_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": mixing.ORACLE,
    "op10_exact": exact.ORACLE,
    "op11_codes": vectorcodes.oracle(),
    "op12_spelling": spelling.ORACLE,
}
