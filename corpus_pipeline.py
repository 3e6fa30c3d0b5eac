"""The corpus pipeline: from raw documents to shards ready for training.

Each stage takes the rows that the one before kept. All but the last return the columns of ``documents``:

1. ``language``: rows whose text is null or has no letter go; any other row stays, whatever its language and
   whether or not any row is labelled.
2. ``near_duplicates``: of each component of near copies (five-word shingles, similarity 0.8) the least id stays.
3. ``decontamination``: rows that hold ten consecutive words of a benchmark item (or a whole shorter one) go.
4. ``mixture``: sources are mixed to flattened shares of their bytes, in schedule order; when one runs out
   the others go on, so all rows stay.
5. ``shards``: adds size, shard (24 of near equal bytes) and slot; the slots of a shard go in the order that the mixture wrote.

Cases: what each operator's module states for null, empty and very long texts, ties, repeated rows and empty tables. Any other
columns of the documents pass all stages with their values, whatever their names; only the last stage puts its size, shard and
slot in place of columns of these names. A stage's result for an empty table is an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import decontamination, language, mixing, ngram_join, sharding
from tickerloom.llm.work import scratch, table
from tickerloom.session import configure, discard, staged

SHARDS = 24
#: The mixture depends on hashes and a schedule, and near copies on components: no SQL for the rows of the whole.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    # Without a usable label, or with one that is the mark itself, the mark says nothing about letters.
    tells = model.languages and language.UNKNOWN not in model.languages
    found = language.prediction(spark, model).getField("lang_pred")
    return docs.filter(found != language.UNKNOWN if tells else language.lettered("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS, in_order=True)


STAGES = [
    ("language", languages), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
    ("mixture", mixture), ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage has staged, and what it has read, is deleted once its result is written.
    """
    docs, before = table(configure(spark), sf_dir, "documents"), []
    for name, apply in STAGES:
        with scratch(spark):
            docs, path = staged(apply(spark, docs, sf_dir), name)
        discard(spark, *before)
        before = [path]
    return docs
