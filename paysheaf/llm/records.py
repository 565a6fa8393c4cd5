"""Document texts from the page texts that the readers and the layout operators give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_text(page_text: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text``, its pages in page order, a line break between them.

    Pages without text count as empty; repeated pages stay, pages without a number come first.
    """
    pages = page_text.select("doc_id", F.struct("page", F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    grouped = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    return grouped.select("doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"))
