"""Is a document a payslip?  Signals on its first pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import WS, strip_accents, text


def _hits(c: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for pattern in patterns:
        total = total + c.rlike(pattern).cast("int")
    return total


def opening_text(page_text: DataFrame, pages: int = vocab.GUARD_PAGES) -> DataFrame:
    """Accent-free lower-case text of the first pages of every document."""
    first = page_text.where(F.col("page") <= pages)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text(F.col("text")).alias("t")))), lambda p: p["t"]), " ")
    plain = F.regexp_replace(F.lower(strip_accents(joined)), f"{WS}+", " ")
    return first.groupBy("doc_id").agg(plain.alias("opening"))


def classify(opening: DataFrame) -> DataFrame:
    """payroll, payroll_candidate, scanned_unknown or rejected with its reason."""
    t = F.col("opening")
    seen = opening.withColumns(
        {
            "payroll_signals": _hits(t, vocab.GUARD_PAYROLL), "timecard_signals": _hits(t, vocab.GUARD_TIMECARD),
            "other_signals": _hits(t, vocab.GUARD_OTHER), "identified": t.rlike(vocab.GUARD_IDENTITY), "has_text": F.trim(t) != "",
        }
    )
    weak = ~F.col("identified") & (F.col("payroll_signals") < 2)
    timecard, other = weak & (F.col("timecard_signals") >= 1), weak & (F.col("other_signals") >= 1)
    verdict = (
        F.when(~F.col("has_text"), "scanned_unknown").when(timecard | other, "rejected").when(weak, "payroll_candidate").otherwise("payroll")
    )
    reason = F.when(~F.col("has_text"), F.lit(None)).when(timecard, vocab.GUARD_REASON_TIMECARD).when(other, vocab.GUARD_REASON_OTHER)
    return seen.select(
        "doc_id", verdict.alias("classification"), reason.alias("reason"), "payroll_signals",
        verdict.isin("scanned_unknown", "payroll_candidate").alias("requires_visual_validation"),
    )


def split(documents: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, quarantined documents with their reason)."""
    rejected = verdicts.where(F.col("classification") == "rejected").select("doc_id", "reason")
    return documents.join(rejected, "doc_id", "left_anti"), documents.join(rejected, "doc_id")
