"""The queries of this package and their oracles."""

from __future__ import annotations

from tessera.llm.contextual_pii import op12
from tessera.llm.decontaminate import op4
from tessera.llm.html_extract import op1
from tessera.llm.license_scan import op10
from tessera.llm.mixing import op3
from tessera.llm.ngram_jaccard import op7
from tessera.llm.periodic_runs import op13
from tessera.llm.quality_rules import op5
from tessera.llm.quote_links import OP2_SQL, op2
from tessera.llm.token_files import op6
from tessera.llm.url_filter import op9
from tessera.llm.warc import op8
from tessera.llm.whitening import op11

QUERIES = {
    "op1_html_extraction": op1,
    "op2_chat_formatting": op2,
    "op3_mixing": op3,
    "op4_decontamination": op4,
    "op5_quality_rules": op5,
    "op6_token_ids": op6,
    "op7_ngram_jaccard": op7,
    "op8_warc": op8,
    "op9_url_filter": op9,
    "op10_license_scan": op10,
    "op11_embedding_whitening": op11,
    "op12_contextual_pii": op12,
    "op13_periodic_runs": op13,
}
ORACLES: dict[str, str] = {"op2_chat_formatting": OP2_SQL}
