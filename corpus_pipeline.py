"""The corpus pipeline: five stages over ``documents``, each one operator of
``catalign.llm``.  A stage takes the documents that the one before kept,
written as Parquet and read again, and returns them with the same columns;
the last returns the packed bins.

For every stage: a null in any column is a value like any other, a null text
is an empty one; rows are judged whole, however long the text; rows that are
repeated are decided each by itself, save where the stage says otherwise; an
empty table gives an empty one; further columns pass the first four stages, but
for names with a leading underscore, which are the stages' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalign.llm import line_spread, mix_ipf, pack_bestfit, simhash_cover, toxicity
from catalign.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.  Equal texts score
    alike, so repeated rows stay or go together."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.split_by_score(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across sites.  A document that
    consisted of nothing else goes: its lines stand where they came first."""
    out = line_spread.remove_boilerplate(docs)
    emptied = (F.col("n_removed") > 0) & (F.length(F.btrim("text", F.lit(" \t\r\n"))) == 0)
    return out.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest doc_id (of
    repeated ids the smallest text).  Texts without a word are one group; rows
    without a doc_id all stay."""
    return simhash_cover.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose mix of sources, languages and topics lies between the
    data's and the target: a document of a cell that is to shrink stays with
    the cell's factor as probability, the others stay, each once."""
    return mix_ipf.mix(docs, scale=1.0).where("mix_sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, n_tokens, doc_ids, pieces) of the packed sample."""
    return pack_bestfit.bins_of(pack_bestfit.pack_documents(docs))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("simhash near-dedup", drop_near_copies),
          ("source mixing", mix_sources), ("best-fit packing", pack_bins)]

#: The classifier and the raking have no SQL form; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
