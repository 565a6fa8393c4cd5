"""Mixing the document texts of companies to target shares of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MAX_COPIES = 3
TOLERANCE = 1e-9
ROUNDS = 60
#: Documents of one company and size that one task puts in order.
ROWS_PER_CELL = 512
CORRECTIONS = 2
SALTS = 16


def sizes(document_text: DataFrame) -> DataFrame:
    """``doc_id, company, size``: words of each text; null: 0."""
    return document_text.select("doc_id", F.col("company").cast("string").alias("company"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def company_key(company: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(company.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), company))


def histogram(sized: DataFrame) -> DataFrame:
    """``key, size, n``: the documents of each company and size."""
    return sized.groupBy(company_key(F.col("company")).alias("key"), "size").agg(F.count("*").alias("n"))


def cyclic_weights(hist: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``key, weight``: companies by code point, null last, weigh the given numbers in turn. One row per company is put in order."""
    keys = hist.select("key").distinct()
    at = F.expr("(row_number() over (order by key) - 1)") % len(weights)
    return keys.select("key", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).alias("weight"))


def targets(hist: DataFrame, weights: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``key, company_size, target``: all words shared by weight, none above ``max_copies`` times the company's size.

    The excess is shared again by weight among the others. A company is full when its cap per weight is at most the level at
    which the rest shares what remains; with caps per weight in order that level is a running sum. One row
    per company takes part.
    """
    total = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("company_size"))
    total = total.join(weights, "key").withColumn("cap", F.col("company_size") * F.lit(float(max_copies)))
    below = "(order by cap / weight, key rows between unbounded preceding and 1 preceding)"
    whole = "(order by cap / weight, key rows between unbounded preceding and unbounded following)"
    level = total.withColumns({
        "words": F.expr("sum(company_size) over ()"), "weights": F.expr("sum(weight) over ()"),
        "full": F.expr(f"coalesce(sum(cap) over {below}, 0.0)"), "gone": F.expr(f"coalesce(sum(weight) over {below}, 0.0)"),
    })
    level = level.withColumn("level", (F.col("words") - F.col("full")) / (F.col("weights") - F.col("gone")))
    level = level.withColumn("open_level", F.expr(f"first(case when cap / weight > level then level end, true) over {whole}"))
    return level.select(
        "key", "company_size",
        F.when(F.col("cap") / F.col("weight") <= F.coalesce("open_level", F.lit(float("inf"))), F.col("cap"))
        .otherwise(F.col("weight") * F.col("open_level")).alias("target"),
    )


def _exact_sum(values: Column) -> Column:
    """A sum that does not depend on the order of the rows, so that reruns agree to the last bit."""
    return F.sum(values.cast("decimal(30,8)")).cast("double")


def tilts(hist: DataFrame, goal: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``key, company_size, target, scale, tilt``: the dual solution, one number per company.

    Rates ``r(d) = min(max_copies, exp(tilt * size / scale))`` are, of all rates with the wanted words of each
    company, those nearest to one copy of every document in relative entropy. The dual is convex and each tilt has its own
    equation ``sum(size * r) = target``. A Newton step on its logarithm, kept inside a bracket, needs one sum over the
    histogram per round. Full companies need no tilt (null), nor do companies without words.
    """
    scale = hist.groupBy("key").agg(
        F.try_divide(_exact_sum(F.col("n") * F.col("size").cast("double") * F.col("size")), _exact_sum(F.col("n") * F.col("size"))).alias("scale"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    state = goal.join(scale, "key").withColumn("solvable", (F.col("target") > 0) & (F.col("target") < max_copies * F.col("company_size") * (1 - 1e-12)))
    least, log_ratio = F.col("least") / F.col("scale"), F.log(F.try_divide("target", "company_size"))
    log_cap = F.log(F.lit(float(max_copies)))
    state = state.select(
        "key", "company_size", "target", "scale", "solvable",
        F.when(F.col("solvable"), F.lit(0.0)).alias("tilt"),
        F.least(log_ratio / least, F.lit(0.0)).alias("low"), F.when(log_ratio > 0, log_cap / least).otherwise(0.0).alias("high"), F.lit(None).cast("double").alias("error"),
    )
    state = stored(state, "tilts")
    x = F.col("size") / F.col("scale")
    rate = F.least(F.lit(float(max_copies)), F.exp(F.col("tilt") * x))
    mass = F.col("n") * F.col("size") * rate
    for _ in range(ROUNDS):
        sums = hist.join(state.where("solvable").select("key", "tilt", "scale"), "key").groupBy("key").agg(
            _exact_sum(mass).alias("taken"), _exact_sum(F.when(F.col("tilt") * x < log_cap, mass * x).otherwise(0.0)).alias("slope")
        )
        step = state.join(sums, "key", "left").withColumn("gap", F.log(F.try_divide("taken", "target")))
        step = step.withColumns({"low": F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - F.col("gap") * F.col("taken") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & newton.between(F.col("low"), F.col("high"))
        step = step.withColumns({
            "error": F.abs("gap"),
            "tilt": F.when(F.abs("gap") <= TOLERANCE, F.col("tilt")).when(inside, newton).when(F.col("solvable"), (F.col("low") + F.col("high")) / 2),
        })
        state = stored(step.select(state.columns), "tilts")
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("key", "company_size", "target", "scale", "tilt")


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def copies(sized: DataFrame, hist: DataFrame, solved: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``doc_id, company, size, company_size, target, rate, copies``.

    Rounding is systematic: the documents of a company stand in the order of size, and one more copy is given each
    time the sum of the rates' fractions passes a whole number; then a document or two per company
    are rounded the other way, so that taken words come within a few words of the target where sizes allow. Reruns agree. Documents of equal size stand in the order of a hash of ``doc_id``,
    in cells of ``ROWS_PER_CELL``, so no company and no size is ordered in one task.
    """
    x = F.col("size") / F.col("scale")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(max_copies))
    rate = rate.otherwise(F.least(F.lit(float(max_copies)), F.exp(F.col("tilt") * x)))
    rated = hist.join(solved, "key").withColumn("rate", rate)
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    # documents of one company and size meet their rate in many tasks
    docs = sized.withColumns({"key": company_key(F.col("company")), "salt": F.pmod(order, F.lit(SALTS))})
    docs = docs.join(_salted(rated), ["key", "size", "salt"]).drop("salt")
    docs = docs.withColumn("cell", F.pmod(order, F.ceil(F.col("n") / ROWS_PER_CELL)))
    cells = docs.groupBy("key", "size", "cell", "rate").agg(F.count("*").alias("m"))
    running = F.expr("coalesce(sum(m * (rate - floor(rate))) over (partition by key order by size, cell rows between unbounded preceding and 1 preceding), 0.0)")
    cells = cells.select("key", "size", "cell", running.alias("before"))
    ranked = docs.withColumn("order", order)
    ranked = ranked.withColumn("rank", F.expr("row_number() over (partition by key, size, cell order by `order`, doc_id)"))
    upto = F.col("before") + F.col("rank") * part + 0.5
    more = F.floor(upto) - F.floor(F.col("before") + (F.col("rank") - 1) * part + 0.5)
    taken = F.least(whole + F.when(part > 0, more).otherwise(0), F.lit(max_copies)).cast("bigint")
    out = ranked.join(cells, ["key", "size", "cell"]).withColumn("copies", taken)
    out = out.select("key", "cell", "rank", "doc_id", "company", "size", "company_size", "target", "rate", "copies")
    out = stored(out, "copies")
    for _ in range(CORRECTIONS):
        out = _corrected(out)
    return out.drop("key", "cell", "rank")


def _corrected(taken: DataFrame) -> DataFrame:
    """Round one document per company the other way: the one whose size best makes up for what its company is over or short."""
    gaps = taken.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    # a company's documents meet its gap in many tasks
    gaps = _salted(gaps)
    salt = F.pmod(F.col("rank") + F.col("size"), F.lit(SALTS)).cast("bigint")
    open_up = (F.col("gap") > 0) & (F.col("copies") < F.ceil("rate"))
    open_down = (F.col("gap") < 0) & (F.col("copies") > F.floor("rate"))
    rest = F.abs(F.abs("gap") - F.col("size"))
    choice = taken.withColumn("salt", salt).join(gaps, ["key", "salt"]).where((open_up | open_down) & (rest < F.abs("gap")))
    place = ["size", "cell", "rank"]
    choice = choice.groupBy("key").agg(F.min(F.struct(rest.alias("rest"), *place, F.signum("gap").cast("bigint").alias("step"))).alias("c"))
    choice = choice.select("key", *[F.col(f"c.{x}").alias(x) for x in (*place, "step")])
    return taken.join(choice, ["key", *place], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).select(taken.columns)


def mixture(document_text: DataFrame, weights: DataFrame | None = None, max_copies: int = MAX_COPIES) -> DataFrame:
    """Copies of each document such that each company's words come near its target share of all words.

    Takes ``doc_id, text, company`` and optionally ``key, weight`` (``company_key``; default: 5, 2, 1 in turn). Null texts have size 0 and
    no copies; documents without a company form a company of their own. Repeated rows count each. No rows give no rows.
    """
    sized = stored(sizes(document_text), "sizes")
    hist = stored(histogram(sized), "histogram")
    goal = targets(hist, cyclic_weights(hist) if weights is None else weights, max_copies)
    return copies(sized, hist, tilts(hist, goal, max_copies), max_copies)


def repeated(document_text: DataFrame, weights: DataFrame | None = None, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mixture itself: every row of ``document_text`` as often as ``mixture`` takes its document, with all its columns."""
    taken = mixture(document_text, weights, max_copies).where("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    joined = document_text.join(taken.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select(document_text.columns)
