"""The corpus pipeline over ``documents``: five stages, each applying one operator of ``tessera.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. Nulls, empty texts, empty tables, repeated rows and
further columns go through as each operator defines them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.op03_ngram_join import ngram_join
from tessera.llm.op05_toxicity import fitted, held_out, scored
from tessera.llm.op06_unit_dedup import unit_dedup
from tessera.llm.op07_decontaminate import contamination
from tessera.llm.op08_pack import pack
from tessera.llm.shared import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Labels of the held-out fifth of ids are not learnt from."""
    model = fitted(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return scored(docs, model).where("score < 0.5").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sharing 80 % of their 5-word shingles the one with the smallest doc_id stays; of repeated rows one."""
    gone = ngram_join(docs, k=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_repeated"))
    if repeated.isEmpty():
        return kept
    again = kept.doc_id.eqNullSafe(repeated._repeated)
    return kept.join(repeated, again, "left_anti").union(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length and runs of 50 words that occurred before leave the text; every document stays, its n_chars follows its text."""
    out = unit_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item, go."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of 2048 tokens, each mixed like the corpus."""
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_lines", repeated_lines), ("decontamination", decontamination), ("packing", packing)]

#: A trained score and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
