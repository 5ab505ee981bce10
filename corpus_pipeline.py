"""Quality rules, exact dedup, near dedup, mixing and packing over documents, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in
their order, and any others that docs has, whatever their names. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.columns import table
from tallyloom.llm.op2_packing import pack
from tallyloom.llm.op3_fertility import keep_good
from tallyloom.llm.op4_exact_dedup import keep_first
from tallyloom.llm.op5_mixing import repeat_documents
from tallyloom.llm.op8_minhash import keep_one
from tallyloom.llm.queries import vocabulary
from tallyloom.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the base rules and the bands of their language or script.

    A null or empty text has no words, so it goes; a null or unknown language, or none at all, is judged by script. Very
    long texts are measured whole. Ties and repeated rows: each row is judged for itself.
    """
    return keep_good(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without their blanks the one with the most code points.

    Ties: the smallest id, a null id before all others. Null and empty texts are equal, so one of them stays. Very long
    texts are hashed in chunks. Repeated rows: one stays.
    """
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 percent of their five-word shingles or more the one with the smallest id.

    Texts without words are linked with nothing and stay; those of fewer than five words are one shingle. Very long
    texts count whole. Repeated rows: one stays. A null id is smaller than all others.
    """
    return keep_one(docs, threshold_percent=80, width=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out, or cut once per source) to the sources' targets.

    A null source is a source of its own, the last. Texts without words take nothing and go. A very long text may be the
    one that is cut. Ties in the seeded order are equal rows; repeated rows are rows of their own.
    """
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 1024 tokens.

    A null or empty text has one token, its end. A very long text fills windows of its own. Repeated rows are packed
    each; a null id stays null.
    """
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokenisers and packing have no SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents below sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
