"""Corpus pipeline: from raw documents to token ids, one operator per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``.

1. toxicity        rows that the classifier scores at its threshold or above go
2. jaccard_join    of each group of near duplicates the row with the least doc_id stays
3. substring_dedup words under a repeated 35-word window go from the text; a text that loses
                   none stays as it was, another keeps its words joined by one space, and
                   n_chars follows the text
4. decontaminate   rows with a twentieth or more of their words in benchmark windows go
5. bpe             token ids of the text, with the digests of ids and decoded text

Null and empty texts pass through (a null text is no duplicate of anything and has no
tokens); repeated rows are near duplicates, of which one stays; rows with a null doc_id are
rows like any other; empty tables give empty results. Columns beyond those of ``documents``
pass the first four stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm import blocks
from pagefold.llm.bpe import encode
from pagefold.llm.decontaminate import drop_contaminated
from pagefold.llm.jaccard_join import drop_near_duplicates
from pagefold.llm.queries import tokenizer_file
from pagefold.llm.substring_dedup import dedup_substrings
from pagefold.llm.toxicity import drop_toxic
from pagefold.session import checkpoint_dir
from pagefold.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = dedup_substrings(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": size}
    return found.select(*[new.get(c, F.col(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file())
    return tokens.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup),
          ("decontaminate", decontaminate), ("bpe", bpe)]

#: A trained classifier decides the first stage, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus_pipeline_{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if done:
            blocks.remove_folder(spark, done)
        done = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
