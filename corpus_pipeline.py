"""From documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.  Calling a stage deletes the tables that the call before it, of the stage before it on
the same folder, left in the shared folder: its output has been written by then.  Other results are not touched.

1. quality      documents that the classifier scores below its threshold go (learned from labels whose crc32(doc_id) mod 5 is not 0)
2. near_dups    one document of each group of SimHash near-duplicates stays, that with the smallest doc_id
3. substrings   words go that lie in a window of 50 words which also starts in a document with a smaller doc_id; a document that loses
                words keeps the others joined by one space, one that loses all goes
4. benchmark    documents that contain a benchmark item go
5. mix          documents of which the mix takes no word go; the others get size, source_size, target and taken
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, mixing, quality_fm, simhash_dedup, substring_dedup
from quillgraph.llm.common import crc_mod, delete, gathered, release, settled, table

#: The classifier, the mixing and the hashing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: (stage, folder, settled tables of its result) of calls whose result may still be read.
_calls: list[tuple[str, str, list[str]]] = []


def _tidy(after: str | None) -> Callable[[Stage], Stage]:
    """Deletes what the last call of stage ``after`` on the folder left, and remembers what this call leaves."""

    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            done = next((c for c in reversed(_calls) if c[:2] == (after, sf_dir)), None)
            if done:
                _calls.remove(done)
                delete(spark, done[2])
                release(spark)
            with gathered() as left:
                out = stage(spark, docs, sf_dir)
            _calls.append((stage.__name__, sf_dir, left))
            return out

        return call

    return wrap


@_tidy(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality_fm.keep(docs, model)


@_tidy("quality")
def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicate(docs)


@_tidy("near_dups")
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_documents(docs)


@_tidy("substrings")
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_tidy("benchmark")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dups", near_dups), ("substrings", substrings), ("benchmark", benchmark), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            delete(spark, [last.settled_at])
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
