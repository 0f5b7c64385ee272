"""Query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.html import extract_pages
from cohortspark.sources.tables import table


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
