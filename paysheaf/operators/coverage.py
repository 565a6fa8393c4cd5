"""What is visible in the text against what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import label_key, lines_of, text, trim_ws
from ..plans.reuse import shared


TOTALS = ("total_additions", "total_deductions", "net_value")


def missing_codes(expected: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Expected k-th occurrence of a code where fewer than k were extracted.

    ``expected`` carries code and occurrence; codes compare as printed.
    """
    counts = (
        extracted.select(*keys, trim_ws(F.col("code")).alias("code")).where(F.col("code") != "")
        .groupBy(*keys, "code").agg(F.count("*").alias("_n"))
    )
    return expected.join(counts, [*keys, "code"], "left").where(F.col("occurrence") > F.coalesce("_n", F.lit(0))).drop("_n")


def extracted_label_keys(extracted: DataFrame, totals: DataFrame | None, keys: list[str]) -> DataFrame:
    """Distinct label keys of a record; present totals count under their label."""
    found = extracted.select(*keys, label_key(F.col("label")).alias("have"))
    if totals is not None:
        names = zip(vocab.TOTAL_LABELS, TOTALS, strict=True)
        present = F.array(*[F.when(trim_ws(F.col(n)) != "", label_key(F.lit(label))) for label, n in names])
        found = found.unionByName(totals.select(*keys, F.explode(present).alias("have")).where(F.col("have").isNotNull()))
    return found.where(F.col("have") != "").distinct()


#: Labels shorter than this are compared with all labels of their record.
GRAM = 3
#: Records with up to this many extracted labels compare them as a list; the labels of larger ones meet through an index.
FEW = 64


def _grams(label: Column) -> Column:
    """All runs of ``GRAM`` characters of a label."""
    at = F.sequence(F.lit(1), F.length(label) - GRAM + 1)
    return F.array_distinct(F.transform(at, lambda i: F.substring(label, i, F.lit(GRAM))))


def _within(inner: DataFrame, short: str, outer: DataFrame, long: str, keys: list[str]) -> DataFrame:
    """Pairs of a record's labels of which the first stands in the second: they share the first one's first run of characters."""
    probe = inner.where(F.length(short) >= GRAM).select(*keys, short, F.substring(short, 1, GRAM).alias("_gram"))
    index = outer.where(F.length(long) >= GRAM).select(*keys, long, F.explode(_grams(F.col(long))).alias("_gram"))
    return probe.join(index, [*keys, "_gram"]).where(F.contains(long, F.col(short))).select(*keys, short, long)


def missing_summaries(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Expected summary labels without an extracted label that equals, contains or lies within them.

    Equal keys are settled first by a plain join. What is open meets its record's labels as one list; those of a record with more than ``FEW`` meet
    through an index of three-character runs instead, so many labels are not compared each with each. Very short labels are.
    """
    wanted = expected.withColumn("want", label_key(F.col("label")))
    open_labels = wanted.join(have.withColumnRenamed("have", "want"), [*keys, "want"], "left_anti")
    rest = [c for c in expected.columns if c not in keys]
    opened = open_labels.groupBy(*keys).agg(F.collect_list(F.struct(*rest, "want")).alias("_open"))
    listed = have.groupBy(*keys).agg(F.collect_set("have").alias("_haves"))

    def met(want: Column) -> Column:
        return F.coalesce(F.exists("_haves", lambda h: F.contains(h, want) | F.contains(want, h)), F.lit(False))

    many = F.coalesce(F.size("_haves") > FEW, F.lit(False))
    told = shared(opened.join(listed, keys, "left").select(
        *keys, F.when(~many, F.filter("_open", lambda o: ~met(o["want"]))).alias("_lost"), F.when(many, F.col("_open")).alias("_open"), F.when(many, F.col("_haves")).alias("_haves")
    ))
    few = told.select(*keys, F.inline("_lost")).select(*expected.columns)
    left = told.select(*keys, F.inline("_open"))
    return few.union(_missing_of_many(left, told.select(*keys, F.explode("_haves").alias("have")), keys).select(*expected.columns))


def _missing_of_many(open_labels: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Open labels that neither contain nor lie within one of ``have``, met through an index of three-character runs."""
    wants = open_labels.select(*keys, "want").distinct()
    met = _within(wants, "want", have, "have", keys).select(*keys, "want")
    met = met.union(_within(have, "have", wants, "want", keys).select(*keys, "want"))
    short_want = wants.where((F.length("want") < GRAM)).join(have, keys).where(F.contains("have", F.col("want")) | F.contains("want", F.col("have")))
    short_have = have.where(F.length("have") < GRAM).join(wants, keys).where(F.contains("want", F.col("have")))
    met = met.union(short_want.select(*keys, "want")).union(short_have.select(*keys, "want")).distinct()
    return open_labels.join(met, [*keys, "want"], "left_anti")


def coverage(
    expected_codes: DataFrame, expected_summaries: DataFrame, lost_codes: DataFrame, lost_summaries: DataFrame,
    extracted: DataFrame, records: DataFrame, keys: list[str], totals: DataFrame | None = None,
) -> DataFrame:
    """Visible, missing and covered share per record (``records`` carries text_length); a record with only totals has something.

    All inputs are counted in one aggregate over their union, which adds up before the shuffle.
    """
    names = ["record", "codes", "summaries", "lost_codes", "lost_summaries", "fields", "bases", "totals"]

    def part(df: DataFrame, length: Column | None = None, **counts: Column) -> DataFrame:
        counted = [F.coalesce(counts[c].cast("long"), F.lit(0)).alias(c) if c in counts else F.lit(0).cast("long").alias(c) for c in names]
        return df.select(*keys, *counted, (F.lit(None).cast("long") if length is None else length.cast("long")).alias("text_length"))

    one = F.lit(1)
    union = part(records, F.col("text_length"), record=one)
    for name, df in (("codes", expected_codes), ("summaries", expected_summaries), ("lost_codes", lost_codes), ("lost_summaries", lost_summaries)):
        union = union.union(part(df, **{name: one}))
    union = union.union(part(extracted, fields=F.col("kind") == "field", bases=F.col("kind") == "base"))
    if totals is not None:
        filled = [F.coalesce(trim_ws(F.col(n)) != "", F.lit(False)) for n in TOTALS]
        union = union.union(part(totals, totals=filled[0] | filled[1] | filled[2]))
    df = union.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], F.max("text_length").alias("text_length")).where("record > 0")
    visible, missing = F.col("codes") + F.col("summaries"), F.col("lost_codes") + F.col("lost_summaries")
    some = (F.col("fields") > 0) | (F.col("bases") > 0) | (F.col("totals") > 0)
    share = F.when(visible > 0, F.greatest(F.lit(0.0), (visible - missing) / visible)).otherwise(F.when(some, 1.0).otherwise(0.0))
    return df.select(
        *keys, visible.alias("expected_count"), F.greatest(F.lit(0).cast("long"), visible - missing).alias("extracted_count"),
        F.col("lost_codes").alias("missing_codes"), F.col("lost_summaries").alias("missing_summaries"),
        share.alias("coverage"), ((missing == 0) & some).alias("valid"),
        ((F.col("fields") == 0) & (F.col("text_length") > 100)).alias("empty_region"),
    )


def visible_codes(block_text: Column) -> Column:
    """Distinct codes printed before a label, line by line."""
    per_line = F.transform(lines_of(block_text), lambda line: F.regexp_extract_all(line, F.lit(vocab.VISIBLE_CODE), 1))
    return F.array_distinct(F.flatten(per_line))


def validate_block(block_text: Column, codes: Column, has_totals: Column, has_bases: Column) -> dict[str, Column]:
    """Checks of one block; coverage compares set sizes and may exceed one.

    ``codes`` is the array of extracted codes.
    """
    wanted = visible_codes(block_text)
    found = F.array_distinct(F.filter(F.transform(codes, trim_ws), lambda c: c != ""))
    lost = F.array_except(wanted, found)
    plain = text(block_text)
    expects_totals = plain.rlike(vocab.EXPECTS_TOTALS)
    expects_bases = plain.rlike(vocab.EXPECTS_BASES)
    share = F.when(F.size(wanted) > 0, F.size(found) / F.size(wanted)).otherwise(F.when(F.size(found) > 0, 1.0).otherwise(0.0))
    return {
        "coverage": share,
        "missing_codes": lost,
        "missing_totals": expects_totals & ~has_totals,
        "missing_bases": expects_bases & ~has_bases,
        "valid": (share >= 0.8) & (~expects_totals | has_totals) & (~expects_bases | has_bases),
    }
