"""Quality rules of document texts and verdicts over the companies that issue them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .shared import stored

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MIN_WORDS = 50
REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOL_PERCENT = 10
DUPLICATE_LINE_PERCENT = 30
#: A company goes when a rule fails in more than this share of its documents, after shrinking.
MAX_FAILURE_RATE = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeated": f"100 * n_repeat_words > {REPEATED_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * word_chars",
    "lines": f"100 * n_dup_lines > {DUPLICATE_LINE_PERCENT} * n_lines",
}
#: The rules that reject a document by itself.
DOCUMENT_RULES = ("short", "repeated")


class Prior(NamedTuple):
    """Beta prior of a rule's failure rate over companies."""

    a: float
    b: float


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measure(texts: bytetext.Texts) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of each text."""
    data, n_texts = texts.data, len(texts.bounds) - 1
    inside = ~bytetext.SPACE[data]
    out = {"n_words": np.diff(texts.bounds), "word_chars": texts.sums(inside & (data & 0xC0 != 0x80)), "n_symbols": texts.sums(SYMBOLS[data])}

    cut = np.zeros(len(data) + 1, bool)
    cut[texts.offsets] = True
    cut[1:][data == 10] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    ends = ends - (data[ends - 1] == 10)
    filled = np.searchsorted(texts.starts, starts) < np.searchsorted(texts.starts, ends)
    starts, ends = starts[filled], ends[filled]
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    keys = texts.hashes(starts, ends) ^ bytetext.mix(owner.astype(np.uint64))
    first = np.unique(keys, return_index=True)[1]
    out["n_lines"] = np.bincount(owner, minlength=n_texts)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=n_texts)

    runs, whole = texts.windows(texts.hashes(), REPEAT_WINDOW)
    covered = np.zeros(len(texts.starts), bool)
    at = np.flatnonzero(whole)
    again = at[_repeated(runs[at] ^ bytetext.mix(texts.owner[at].astype(np.uint64)))]
    for j in range(REPEAT_WINDOW):
        covered[again + j] = True
    out["n_repeat_words"] = texts.word_sums(covered)
    return out


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytetext.chunks(batch):
            counts = measure(bytetext.parse(part.column("text"), lower=False))
            carried = [c for c in part.schema.names if c != "text" or "row" in part.schema.names]
            columns = [*(part.column(c) for c in carried), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, *COUNTS])


def measures(document_text: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id, company``, the ``COUNTS`` and one boolean ``fails_<rule>`` for each of ``RULES``.

    With ``carry`` also ``text`` and, as the struct ``row``, all other columns.
    """
    docs = document_text.select("doc_id", F.col("company").cast("string").alias("company"), "text")
    if carry:
        rest = [c for c in document_text.columns if c not in ("doc_id", "company", "text")]
        docs = document_text.select("doc_id", F.col("company").cast("string").alias("company"), "text", F.struct(F.lit(0).alias("_"), *rest).alias("row"))
    kept = docs.drop("text") if not carry else docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.mapInArrow(_measures, schema).withColumns({f"fails_{r}": F.expr(rule) for r, rule in RULES.items()})


def company_failures(measured: DataFrame) -> DataFrame:
    """``company, n_documents`` and ``n_<rule>`` failures; documents without a company take no part."""
    return measured.where("company is not null").groupBy("company").agg(
        F.count("*").alias("n_documents"), *(F.count_if(f"fails_{r}").alias(f"n_{r}") for r in RULES)
    )


def priors(failures: DataFrame) -> dict[str, Prior]:
    """Beta prior of each rule, by the moments of the companies' rates.

    Means and variances weigh companies by documents; the sampling variance is taken off. Where companies
    do not differ beyond chance, the prior is worth all documents of a mean company.
    """
    weight, sums = F.col("n_documents"), [F.sum("n_documents").alias("n"), F.count("*").alias("k")]
    for r in RULES:
        sums += [F.sum(f"n_{r}").alias(f"f_{r}"), F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / weight).alias(f"s_{r}")]
    row = failures.agg(*sums).first()
    out = {}
    for r in RULES:
        if not row["n"]:
            out[r] = Prior(1.0, 1.0)
            continue
        n, k = row["n"], row["k"]
        mean = (row[f"f_{r}"] + 0.5) / (n + 1)
        spread = max(0.0, row[f"s_{r}"] / n - (row[f"f_{r}"] / n) ** 2)
        per_company = n / k
        between = max(spread - mean * (1 - mean) / per_company, 0.0)
        strength = min(per_company, max(1.0, mean * (1 - mean) / between - 1)) if between else per_company
        out[r] = Prior(mean * strength, (1 - mean) * strength)
    return out


def company_verdicts(failures: DataFrame, prior: dict[str, Prior], max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """``company``, shrunk ``rate_<rule>`` (posterior means) and ``company_kept``: no rate above ``max_rate``."""
    rates = {f"rate_{r}": (F.col(f"n_{r}") + F.lit(p.a)) / (F.col("n_documents") + F.lit(p.a + p.b)) for r, p in prior.items()}
    out = failures.withColumns(rates)
    return out.select("company", *rates, (F.greatest(*rates) <= max_rate).alias("company_kept"))


#: Rejected companies up to this number are sent to every task; more are joined by shuffling.
SENT_COMPANIES = 50_000


def rejected_companies(document_text: DataFrame, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """``company, rejected`` (true): the companies whose shrunk rate of some rule is above ``max_rate``."""
    failures = stored(company_failures(measures(document_text)), "failures")
    verdicts = company_verdicts(failures, priors(failures), max_rate)
    rejected = stored(verdicts.where("not company_kept").select("company", F.lit(True).alias("rejected")), "rejected")
    return F.broadcast(rejected) if rejected.count() <= SENT_COMPANIES else rejected


def judged(document_text: DataFrame, max_rate: float = MAX_FAILURE_RATE, carry: bool = False) -> DataFrame:
    """Each document's counts with its own and its company's verdict.

    Takes ``doc_id, text, company``; gives ``doc_id, company``, ``COUNTS``, ``base_failed`` (a document rule fails),
    ``company_kept``, ``kept`` (neither rejects it); with ``carry`` also ``text`` and the other columns in the struct ``row``.
    Null texts count as empty. Documents without a company are judged by their own rules only.
    Repeated rows count and come back as often; an empty table gives no rows.
    """
    rejected = rejected_companies(document_text, max_rate)
    measured = measures(document_text, carry)
    base_failed = F.expr(" or ".join(f"fails_{r}" for r in DOCUMENT_RULES))
    out = measured.join(rejected, "company", "left").withColumns({"base_failed": base_failed, "company_kept": F.col("rejected").isNull()})
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("company_kept"))
    return out.select("doc_id", "company", *(["text", "row"] if carry else []), *COUNTS, "base_failed", "company_kept", "kept")
