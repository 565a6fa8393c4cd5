"""Secrets in document texts, found once per content and rule version."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if ``group`` of it has ``min_chars`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    min_chars: int


# fixed values: the base rules, then the added ones, in their order within a text position
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 32),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
# a whole key: to its END line if that comes before another BEGIN line, else over the header and base64 lines that follow
_KEY_BLOCK = (
    r"""-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?>[\s\S]*?-----(?=(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----))END [A-Z ]*PRIVATE KEY-----"""
    r"""|(?:\s+(?:Proc-Type|DEK-Info): [^\r\n]*)*+(?:(?:\s+[A-Za-z0-9+/]{16,}={0,2}(?!\S))++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]+={0,2}(?=[ \t]*(?:[\r\n]|$)))?)?)"""
)
#: The rules for taking secrets out of texts: as ``RULES``, with the key below its first line.
CLEANING_RULES = tuple(replace(r, version=2, pattern=_KEY_BLOCK) if r.kind == "private_key" else r for r in RULES)
BASE_KINDS = ("assign", "access", "hex")

LEDGER = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start bigint, end bigint"


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def blobs(versions: DataFrame) -> DataFrame:
    """``doc_id, attempts, blob`` of each stored version of a document text."""
    return versions.select("doc_id", "attempts", blob_of(F.col("text")).alias("blob"))


def unseen(blob_paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, version`` pairs that no earlier run has scanned."""
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    wanted = blob_paths.select("blob").distinct().select("blob", F.inline(pairs))
    return wanted.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")


def _matches(rules: tuple[Rule, ...]) -> Column:
    """One struct per rule whose pattern occurs in ``text`` and that ``todo`` asks for."""
    structs = []
    for r in rules:
        hit = F.col("text").rlike(r.pattern) & F.array_contains("todo", r.kind)
        structs.append(F.when(hit, F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.min_chars).alias("min_chars"),
            F.split("text", r.pattern, -1).alias("between"),
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match"),
                F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part"),
            ).alias("matches"),
        )))
    return F.array_compact(F.array(*structs))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``FINDINGS`` of ``texts(blob, text, todo)``: spans in code points, end exclusive, leftmost and non-overlapping per kind.

    A start is the length of everything before it: the pieces between the matches and the matches themselves.
    """
    hits = texts.select("blob", F.explode(_matches(rules)).alias("hit")).select("blob", "hit.*")
    each = hits.select("blob", "kind", "version", "min_chars", "between", F.posexplode("matches").alias("n", "m"))
    each = each.select(
        "blob", "kind", "version", "min_chars", "n", F.length(F.get("between", F.col("n"))).alias("gap"),
        F.length("m.match").alias("chars"), F.length("m.part").alias("part_chars"),
    )
    before = "sum(gap + chars) over (partition by blob, kind order by n rows between unbounded preceding and current row)"
    spans = each.withColumn("end", F.expr(before)).withColumn("start", F.col("end") - F.col("chars"))
    return spans.where("part_chars >= min_chars").select("blob", "kind", "version", "start", "end")


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ``FINDINGS``: each content that lacks a rule version in the ledger is scanned once, from its first path."""
    paths = blobs(versions)
    todo = unseen(paths, ledger, rules).groupBy("blob").agg(F.collect_set("kind").alias("todo"))
    first = paths.groupBy("blob").agg(F.min(F.struct("doc_id", "attempts")).alias("first"))
    first = first.join(todo, "blob").select("blob", "first.*", "todo")
    rows = versions.select("doc_id", "attempts", F.coalesce("text", F.lit("")).alias("text"), blob_of(F.col("text")).alias("content"))
    same = rows["doc_id"].eqNullSafe(first["doc_id"]) & rows["attempts"].eqNullSafe(first["attempts"]) & (rows["content"] == first["blob"])
    return scan(rows.join(first.hint("shuffle_hash"), same).select("blob", "text", "todo"), rules).distinct()


def scanned(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after this run."""
    return ledger.select("blob", "kind", "version").union(unseen(blobs(versions), ledger, rules))


def by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each version of each document, of the current versions of the rules.

    Takes ``doc_id, attempts, text`` and ``FINDINGS``; gives ``doc_id, attempts, blob`` and ``spans``, an array of
    ``(start, end, rule_ord, kind)`` in the order of start, then rule (empty where nothing was found).
    Null texts are empty; repeated paths come back as often; an empty table gives no rows.
    """
    order = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    current = F.coalesce(*[F.when(F.col("kind") == r.kind, F.col("version") == r.version) for r in rules])
    per_blob = findings.where(current).groupBy("blob").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", order.alias("rule_ord"), "kind")),
                     lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(a["rule_ord"] - b["rule_ord"]).cast("int")).alias("spans")
    )
    out = blobs(versions).join(per_blob, "blob", "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,rule_ord:int,kind:string>>")
    return out.select("doc_id", "attempts", "blob", F.coalesce("spans", empty).alias("spans"))


def empty_ledger(versions: DataFrame) -> DataFrame:
    return versions.sparkSession.createDataFrame([], LEDGER)


def kept(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Ledger and findings of all runs that wrote to ``folder``; empty before the first."""
    out = []
    for name, schema in (("ledger", LEDGER), ("findings", FINDINGS)):
        try:
            out.append(spark.read.schema(schema).parquet(f"{folder}/{name}"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            out.append(spark.createDataFrame([], schema))
    return out[0], out[1]


def secrets(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, earlier: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """Scan what ``ledger`` lacks and give the findings of every path (``by_path``), those of earlier runs included.

    ``earlier`` holds the ``FINDINGS`` of the runs in the ledger. Or ``folder`` keeps both from run to run: findings are
    written before the ledger, so a run that fails between them is scanned again and repeats rows, which do not count twice.
    """
    if (ledger is None) != (earlier is None) or (folder is not None and ledger is not None):
        raise ValueError("a ledger needs the findings of its runs; give both, or a folder that holds them")
    if folder is not None:
        ledger, earlier = kept(versions.sparkSession, folder)
    new = stored(scan_unseen(versions, empty_ledger(versions) if ledger is None else ledger, rules), "findings")
    if folder is not None:
        pairs = stored(unseen(blobs(versions), ledger, rules), "ledger")
        new.write.mode("append").parquet(f"{folder}/findings")
        pairs.write.mode("append").parquet(f"{folder}/ledger")
    return by_path(versions, new if earlier is None else earlier.select(new.columns).union(new), rules)


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def printed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[removed]") -> Column:
    """``text`` with every found span replaced; overlapping spans are merged."""
    start = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark)))
            .otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, start).otherwise(text)


def cleaned(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = CLEANING_RULES, earlier: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """``versions`` with every secret in ``text`` replaced by a mark, also those that earlier runs found (see ``secrets``); all rows and columns stay."""
    found = secrets(versions, ledger, rules, earlier, folder).where(F.size("spans") > 0).distinct()
    found = found.select(F.struct("doc_id", "attempts").alias("_path"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    same = F.struct("doc_id", "attempts").eqNullSafe(F.col("_path")) & (blob_of(F.col("text")) == F.col("_blob"))
    joined = versions.join(found.hint("shuffle_hash"), same, "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("_spans")))
    return joined.withColumn("text", text).select(versions.columns)
