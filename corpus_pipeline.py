"""From documents to token files: quality rules, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

import os
import uuid

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, neardup, quality, tokens
from corpusloom.llm._store import collected, delete_unread, shared_dir, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the tables that the last stage wrote on its way.
_before: list[str] = []


def _stage(stage: Stage) -> Stage:
    """A stage that first deletes what the one before it wrote on its way, as its result has been written and reread.

    A table that the documents given still read, as when the result wasn't reread, stays.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_unread(spark, _before, docs)
        with collected() as made:
            out = stage(spark, docs, sf_dir)
        _before[:] = made
        return out

    return run

TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees.

    Null and empty texts fail; of rows that repeat all stay or all go; an empty table gives none.
    Columns of any name stay as they are.
    """
    forest = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).filter("result.kept").select("row.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles and similarity 0.8 connect.

    Null and empty texts are groups of their own, rows equal in id and text are one, and a null or
    repeated id costs no row of another text. An empty table gives none.
    """
    return neardup.dedup(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark passages.

    Null and empty texts have no words and stay, each row is judged by itself, and an empty table or
    benchmark takes nothing away. Columns of any name stay as they are.
    """
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice, by temperature weights.

    A null source is a source; texts without words stay once; rows equal in id, source and text get
    the same number of copies. The mixture's order follows from the rows: see ``mixing.ordered``.
    """
    return mixing.mixed(docs, repeats=2.0)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token files, which are in the mixture's order, read back from them.

    Null texts are empty and have the end id alone; every row is written, null and repeated ids too.
    """
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(mixing.ordered(docs), path, TOKENIZER, order="position")
    return tokens.read(spark, path, ids=False)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("token_output", token_output)]

#: Trees, sketches and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and reread, and deleted once the next stage's are."""
    docs = _table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with collected() as own:
            found = stage(spark, docs, sf_dir)
            on_the_way = len(own)
            docs = written(found, name)
        delete_unread(spark, before, docs)
        before = own[on_the_way:]
    return STAGES[-1][1](spark, docs, sf_dir)
