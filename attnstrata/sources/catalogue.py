"""The fact catalogue: question templates and facts, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATES_SCHEMA = "template_id string, question_form string, statement_form string"
FACTS_SCHEMA = "fact_id bigint, template_id string, subject string, object string"


def read_catalogue(
    spark: SparkSession, templates_path: str, facts_path: str
) -> tuple[DataFrame, DataFrame]:
    """(templates, facts). Repeated facts are separate rows; ``fact_id`` is their
    place in the catalogue.
    """
    return (
        spark.read.schema(TEMPLATES_SCHEMA).parquet(templates_path),
        spark.read.schema(FACTS_SCHEMA).parquet(facts_path),
    )


def write_catalogue(
    templates: DataFrame, facts: DataFrame, templates_path: str, facts_path: str
) -> None:
    templates.selectExpr("template_id", "question_form", "statement_form").write.parquet(
        templates_path
    )
    facts.selectExpr("fact_id", "template_id", "subject", "object").write.parquet(facts_path)
