"""documents to a training mix, in five stages: each works on all rows that the one before kept.

Every stage is written as Parquet and read again before the next one starts, so a lost executor costs a stage at most.
What a stage has staged for itself, and its input, are deleted when its result is written.
Rows of null or empty text pass all stages (nothing is found in them) and are taken 0 times by the mix, so they end
there; repeated rows are near duplicates of each other, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from pagewarden.llm.shared import release, staged, staged_so_far, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model scores below 0.5 stay. A column `score` of their own stays as it is."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component the row of the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.filter(F.size("hit") == 0).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what the scan finds in them is masked, and n_chars follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with size, source_size, target and taken."""
    return mixing.mix(docs, table(spark, sf_dir, "labels")).filter(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: Boosted trees are not SQL. tests/llm/test_pipeline.py applies the stages' rules by plain Python to what each stage gets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), staged_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name.replace(' ', '-')}")
            release(spark, mark, keep=1)  # the next stage reads this table alone
    return docs
