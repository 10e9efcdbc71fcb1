"""The dealt operators' queries and their SQL."""

from __future__ import annotations

from gatelens.llm.decontam import OP5_SQL, op5_decontamination
from gatelens.llm.jaccard import OP6_SQL, op6_jaccard_join
from gatelens.llm.langid import op2_languages
from gatelens.llm.linededup import OP3_SQL, op3_line_dedup
from gatelens.llm.mixing import OP11_SQL, op11_mixing
from gatelens.llm.nbsvm import op10_quality
from gatelens.llm.negatives import OP12_SQL, op12_hard_negatives
from gatelens.llm.packing import op8_packing
from gatelens.llm.rptree import OP7_SQL, op7_vector_dedup
from gatelens.llm.secrets import op1_secret_scan
from gatelens.llm.structure import op13_structure_repair
from gatelens.llm.urlfilter import OP4_SQL, op4_url_filter
from gatelens.llm.warc import OP9_SQL, op9_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_languages, op3_line_dedup, op4_url_filter, op5_decontamination, op6_jaccard_join, op7_vector_dedup, op8_packing, op9_warc, op10_quality, op11_mixing, op12_hard_negatives, op13_structure_repair)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are held against brute force in the tests."""
    return {
        "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_decontamination": OP5_SQL,
        "op6_jaccard_join": OP6_SQL, "op7_vector_dedup": OP7_SQL, "op9_warc": OP9_SQL, "op11_mixing": OP11_SQL, "op12_hard_negatives": OP12_SQL,
    }
