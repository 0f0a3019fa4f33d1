"""A training corpus from raw documents: known languages, lines and documents once, no benchmark text, a set mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import stored, table
from helixframe.llm.decontaminate import drop_contaminated
from helixframe.llm.langid import keep_known
from helixframe.llm.linededup import drop_lines
from helixframe.llm.mixing import mix_sources
from helixframe.llm.neardup import keep_first

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", keep_known),
    ("line_dedup", drop_lines),
    ("minhash_neardup", keep_first),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]
#: Language identification has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
