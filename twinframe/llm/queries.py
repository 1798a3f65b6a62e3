"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from twinframe.llm.op1_quality import op1_quality
from twinframe.llm.op2_suffix import op2_suffix
from twinframe.llm.op3_decontaminate import op3_decontaminate
from twinframe.llm.op4_vectors import op4_vectors
from twinframe.llm.op5_toxicity import op5_toxicity
from twinframe.llm.op6_records import op6_records
from twinframe.llm.op7_language import op7_language
from twinframe.llm.op8_substring import op8_substring
from twinframe.llm.op9_mixing import OP9_SQL, op9_mixing
from twinframe.llm.op10_simhash import op10_simhash
from twinframe.llm.op11_tokens import op11_tokens
from twinframe.llm.op12_search import OP12_SQL, op12_search
from twinframe.llm.op13_spellings import op13_spellings


def queries() -> dict:
    found = [
        op1_quality, op2_suffix, op3_decontaminate, op4_vectors, op5_toxicity, op6_records, op7_language, op8_substring,
        op9_mixing, op10_simhash, op11_tokens, op12_search, op13_spellings,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL, "op12_search": OP12_SQL}
