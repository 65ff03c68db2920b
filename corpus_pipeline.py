"""Corpus preparation in stages; each works on all that its predecessor kept.

language_id        drops documents without a letter (null texts too), whose language can't be told; without rows to
                   learn languages from, it keeps the same rows
line_dedup         removes lines that stand on many sites from the texts, and sets n_chars anew
near_duplicates    keeps the document of the least id of each group linked by the n-gram join, at five words
                   a shingle and a Jaccard similarity of 0.8 (op6 has four words and 0.85)
decontaminate      drops documents of which a twentieth or more is benchmark text
pack               cuts the rest into power-of-two sequences of token ids

Other columns of documents, whatever their names, come through all stages but the last; documents may lack n_chars.  Null
texts and texts without letters go in the first stage; repeated rows go in the third; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from tidewell.llm.common import checkpoint, table

#: Near duplicates of the stage; op6's own rule is in ngram_join.
STAGE_NGRAM, STAGE_PERCENT = 5, 80


#: Columns that the stages use.
USED = ("doc_id", "text", "lang", "source")


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows with all columns of docs as they came, whatever their names: it sees those it uses, and the
    others as one."""
    others = [c for c in docs.columns if c not in USED]
    apart = docs.select(*[c for c in docs.columns if c in USED], F.struct(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("int").alias("__none")).alias("others"))
    return stage(apart).select(*[F.col(c) if c in USED else F.col("others").getField(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = language_id.learn(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return beside(docs, lambda rows: language_id.predict(rows, network).where(F.col("lang_pred") != language_id.UNKNOWN))


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = beside(docs, line_dedup.remove_boilerplate)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return beside(docs, lambda rows: ngram_join.one_of_each(rows, percent=STAGE_PERCENT, ngram=STAGE_NGRAM))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return beside(docs, lambda rows: decontaminate.mark_contamination(rows, benchmark).where(~F.col("contaminated")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

#: Language identification and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents.  Between stages the rows are written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpoint(docs), sf_dir)
    return docs
