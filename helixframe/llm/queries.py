"""Registered queries of this subpackage and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from helixframe.llm.decontaminate import OP3_SQL, op3_decontamination
from helixframe.llm.divergence import OP12_SQL, op12_source_divergence
from helixframe.llm.filteraudit import OP13_SQL, op13_filter_audit
from helixframe.llm.html import op8_html_extraction
from helixframe.llm.langid import op5_language_id
from helixframe.llm.linededup import OP4_SQL, op4_line_dedup
from helixframe.llm.lmscore import op7_lm_scoring
from helixframe.llm.mixing import OP6_SQL, op6_mixing
from helixframe.llm.neardup import OP10_SQL, op10_minhash_neardup
from helixframe.llm.parityjoin import OP11_SQL, op11_parity_join
from helixframe.llm.repetition import op2_quality_rules
from helixframe.llm.secrets import op1_secret_scan
from helixframe.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_decontamination, op4_line_dedup, op5_language_id, op6_mixing, op7_lm_scoring, op8_html_extraction, op9_toxicity, op10_minhash_neardup,
                             op11_parity_join, op12_source_divergence, op13_filter_audit)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op10_minhash_neardup": OP10_SQL,
                           "op11_parity_join": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_audit": OP13_SQL}
