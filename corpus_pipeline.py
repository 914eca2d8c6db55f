"""From documents to token ids: quality, near-duplicates, personal data, mixing, tokens."""

from stratocast.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = pipeline.ORACLE_SQL


def run(spark, sf_dir):
    """All stages over ``documents``; each is written as Parquet and read back."""
    return pipeline.run(spark, sf_dir, STAGES)
