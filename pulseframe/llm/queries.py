"""The queries of the training-data operators and of the pipeline over them."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run

from .conversations import op11_conversation_repair
from .decontaminate import op5_decontaminate
from .jaccard import op9_jaccard_join
from .line_dedup import op1_line_dedup
from .mixing import op3_source_mixing
from .oracles import SQL
from .packing import op12_packing
from .ranked import op13_ranked_search
from .repeats import op6_suffix_array_dedup
from .secrets import op2_secret_scan
from .toxicity import op10_toxicity
from .url_filter import op8_url_filter
from .vectors import op4_embedding_dedup
from .warc import op7_warc_normalise


def queries() -> dict:
    return {"pipeline": run} | {f.__name__: f for f in (op1_line_dedup, op2_secret_scan, op3_source_mixing, op4_embedding_dedup, op5_decontaminate, op6_suffix_array_dedup, op7_warc_normalise, op8_url_filter, op9_jaccard_join, op10_toxicity, op11_conversation_repair, op12_packing, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
