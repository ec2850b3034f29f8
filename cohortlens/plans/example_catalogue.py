"""A small example of the catalogues that a user of ``operators.recommend`` supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators.recommend import METHOD_SCHEMA, METHODS_ENRICH, METHODS_SUPPORT, RULE_SCHEMA, RULES


def rules(spark: SparkSession) -> DataFrame:
    """Each rule asks for one talk, about its category, and names one contact."""
    return spark.createDataFrame([(rid, cat, pri, [f"Talk about: {cat}"], [f"{pri} list"]) for rid, cat, pri in RULES], RULE_SCHEMA)


def methods(spark: SparkSession) -> DataFrame:
    rows = [(g, i + 1, m, f"Example entry for {m}", ["To be named by the school"])
            for g, names in (("support", METHODS_SUPPORT), ("enrich", METHODS_ENRICH)) for i, m in enumerate(names)]
    return spark.createDataFrame(rows, METHOD_SCHEMA)
