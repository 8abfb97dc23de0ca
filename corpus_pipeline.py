"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared checkpoint folder and reread as the next one's ``docs``:

1. language_id: documents go that have no letters, or that the network scores below what all but a thousandth of the
   held-out documents it names rightly reach;
2. near_duplicates: of each group linked by 5-word shingles (Jaccard 0.8) one row stays, that with the smallest doc_id;
3. decontaminate: documents with benchmark words go;
4. mix_sources: every document appears as often as the mix takes it, 0 to 3 times;
5. token_ids: what is left is written as token ids; returns doc_id, start, n_tokens, ids_crc32.

All but the last return the columns of their input.  What a stage holds (broadcast tables, checkpoints, its input when
the next stage has read it) is freed before the next begins.

Cases: a null text goes with the first stage, as empty texts and texts without letters do; rows with a null doc_id are
rows like any other, and of a group they stay only where no row has an id; repeated rows count as one group; ties are
broken by the text's hash, then by the other columns; very long texts are processed whole; further columns, of whatever
name, are carried to the last stage; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlens.llm import decontaminate, jaccard_join, langid, mixing, tokens
from readlens.llm.common import read, scratch_path
from readlens.llm.registry import token_path
from readlens.plans.materialize import delete_folder, lifetime


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(docs)
    return langid.keep_identified(docs, net, langid.rejection_score(docs, net))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), mode="document")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_id_output(docs, token_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
    ("token_ids", token_ids),
]

#: The trained network, the pair join and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with lifetime():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
