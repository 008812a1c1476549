"""The registered query of :mod:`fleet_audit.llm.html_extract`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.html_extract import extract, fit_extraction
from fleet_audit.llm.shared import table


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = extract(pages, fit_extraction(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
