"""Positioned tokens into lines, spatial text, payslip regions and page halves.

A page is the natural unit here: its tokens, lines or cut candidates are put into
arrays per page (or per region), never per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import any_of, collapse_ws, standard_payroll_type, trim_ws

PAGE = ["doc_id", "page"]
HEADER = any_of(vocab.HEADER_PATTERNS)
FOOTER = any_of(vocab.FOOTER_PATTERNS)


def bucket(y: Column, step: int = 4) -> Column:
    """Nearest multiple of ``step``, halves upward."""
    return F.floor(y / step + 0.5) * step


def filled(tokens: DataFrame) -> DataFrame:
    return tokens.where(trim_ws(F.col("str")) != "")


def visual_lines(tokens: DataFrame, keys: list[str] = PAGE, step: int = 4) -> DataFrame:
    """Tokens of one height bucket as a line, ordered by x."""
    row = F.struct("x", "item_ord", "str", "width")
    lines = filled(tokens).groupBy(*keys, bucket(F.col("y"), step).alias("line_y")).agg(
        F.array_sort(F.collect_list(row)).alias("items")
    )
    return lines.withColumn("text", collapse_ws(F.array_join(F.transform("items", lambda i: i["str"]), " ")))


def cluster_lines(tokens: DataFrame, keys: list[str] = PAGE, tolerance: float = 3.0) -> DataFrame:
    """Tokens with the line each joins: the first line within ``tolerance`` of its first token.

    Lines open in token order.  Which line a token joins depends on its height only, and
    heights further apart than ``tolerance`` know nothing of each other: a sweep over the sorted heights
    cuts the page where a gap is wider, and the fold runs over the heights between two gaps.
    """
    rest = [c for c in tokens.columns if c not in (*keys, "y")]
    live = filled(tokens).dropna(subset=[*keys, "y"])
    # the tokens go with their height, so they do not meet their page's heights in a join
    heights = live.groupBy(*keys, "y").agg(F.min("item_ord").alias("at"), F.collect_list(F.struct(*rest)).alias("toks"))
    sweep = Window.partitionBy(*keys).orderBy("y")
    parted = heights.withColumn("_far", (F.col("y") - F.lag("y").over(sweep) > tolerance).cast("int"))
    parted = parted.withColumn("_band", F.sum(F.coalesce("_far", F.lit(0))).over(sweep))
    bands = parted.groupBy(*keys, "_band").agg(F.array_sort(F.collect_list(F.struct("at", "y", "toks"))).alias("hs"))
    bands = bands.withColumn("ys", F.transform("hs", lambda h: F.struct(h["at"].alias("at"), h["y"].alias("y"))))

    def opened(done: Column, h: Column) -> Column:
        return F.when(F.exists(done, lambda l: F.abs(l - h["y"]) <= tolerance), done).otherwise(F.concat(done, F.array(h["y"])))

    # heights that all reach the first one make one line
    first = F.col("ys")[0]["y"]
    one = F.forall("ys", lambda h: F.abs(h["y"] - first) <= tolerance)
    lines = F.when(one, F.array(first)).otherwise(F.aggregate("ys", F.expr("cast(array() as array<double>)"), opened))
    line = F.element_at(F.filter("lines", lambda l: F.abs(l - F.col("h.y")) <= tolerance), 1)
    joined = bands.withColumn("lines", lines).select(*keys, "lines", F.explode("hs").alias("h")).select(*keys, F.col("h.y").alias("y"), line.alias("line_y"), F.explode("h.toks").alias("t"))
    return joined.select(*keys, "y", *[F.col("t")[c].alias(c) for c in rest], "line_y")


def clustered_text(clustered: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row per clustered line with its text and token count."""
    rows = F.array_sort(F.collect_list(F.struct("x", "item_ord", "str")))
    return clustered.groupBy(*keys, "line_y").agg(
        collapse_ws(F.array_join(F.transform(rows, lambda i: i["str"]), " ")).alias("text"), F.count("*").alias("n_items")
    )


def spatial_text(tokens: DataFrame, keys: list[str] = PAGE, fixed_gap: float | None = None) -> DataFrame:
    """Text of a page or block with a column mark where the gap between tokens is wide.

    The limit is 1.5 times the upper median of the positive gaps, between 10 and 40, or
    ``fixed_gap``.
    """
    row = F.struct(bucket(F.col("y")).alias("b"), "x", "item_ord", "str", F.coalesce("width", F.lit(0.0)).alias("w"))
    pages = filled(tokens).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("toks"))
    pages = pages.withColumn(
        "steps",
        F.zip_with(
            "toks",
            F.concat(F.array(F.lit(None)), F.slice("toks", 1, F.size("toks") - 1)),
            lambda cur, prev: F.struct(
                cur["str"].alias("str"),
                prev.isNull().alias("first"),
                (cur["b"] == prev["b"]).alias("same"),
                (cur["x"] - (prev["x"] + prev["w"])).alias("gap"),
            ),
        ),
    )
    if fixed_gap is None:
        gaps = F.sort_array(F.transform(F.filter("steps", lambda s: s["same"] & (s["gap"] > 0)), lambda s: s["gap"]))
        median = F.coalesce(F.try_element_at(gaps, (F.floor(F.size(gaps) / 2) + 1).cast("int")), F.lit(vocab.COLUMN_GAP))
        pages = pages.withColumn("limit", F.greatest(F.lit(10.0), F.least(F.lit(40.0), median * 1.5)))
    else:
        pages = pages.withColumn("limit", F.lit(fixed_gap))

    def printed(step: Column) -> Column:
        mark = F.when(~step["same"], "\n").when(step["gap"] > F.col("limit"), "  |  ").otherwise(" ")
        return F.when(step["first"], step["str"]).otherwise(F.concat(mark, step["str"]))

    return pages.select(*keys, F.array_join(F.transform("steps", printed), "").alias("text"))


def page_density(tokens: DataFrame, pages: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Characters, tokens and lines per page; pages without tokens count as scanned."""
    word = trim_ws(F.col("str"))
    counted = tokens.groupBy(*keys).agg(
        F.sum(F.length(word)).alias("char_count"), F.count("*").alias("element_count"),
        F.count_distinct(F.when(word != "", bucket(F.coalesce("y", F.lit(0.0))))).alias("line_count"),
    )
    full = pages.select(*keys).join(counted, keys, "left").na.fill(0, ["char_count", "element_count", "line_count"])
    chars = F.col("char_count")
    return full.withColumns(
        {"is_sparse": chars < 100, "is_scanned": (chars < 50) | ((F.col("element_count") <= 4) & (chars < 200))}
    )


def strategy(is_month_sheet: Column, is_scanned: Column, chars: Column) -> Column:
    return F.when(is_month_sheet, "FICHA_BLOCK").when(is_scanned | (chars < 50), "VISION_SINGLE_PASS").otherwise("DUAL_PASS")


def _kept(marks: Column, distance: float) -> Column:
    """Marks farther than ``distance`` from the last one kept."""
    def keep(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = F.coalesce(F.abs(m["y"] - last["y"]) <= distance, F.lit(False))
        return F.when(near, done).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(marks, F.expr("cast(array() as array<struct<y:double,text:string>>)"), keep)


def payslip_regions(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions of every page: by repeated headers, else by footers, else the whole page.

    ``pages`` holds doc_id, page and page_height; every page gets at least one region.
    """
    lines = clustered_text(cluster_lines(tokens))
    mark = F.struct(F.col("line_y").alias("y"), "text")
    marks = lines.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.when(F.col("text").rlike(HEADER), mark))).alias("heads"),
        F.array_sort(F.collect_list(F.when(F.col("text").rlike(FOOTER), mark))).alias("feet"),
        F.max("line_y").alias("max_y"),
    )
    known = pages.select(*PAGE, F.coalesce("page_height", F.lit(842.0)).alias("height")).join(marks, PAGE, "left")
    known = known.withColumns({"heads": _kept(F.col("heads"), 55.0), "feet": _kept(F.col("feet"), 30.0)})

    def region(i: Column, start: Column, end: Column, lo: Column, hi: Column, head: Column, confidence: float, fallback: bool) -> Column:
        return F.struct(
            i.cast("int").alias("index"), (F.floor(start * 100 + 0.5) / 100).alias("y_start"), (F.floor(end * 100 + 0.5) / 100).alias("y_end"),
            lo.alias("lo"), hi.alias("hi"), head.alias("header_text"), F.lit(confidence).alias("confidence"), F.lit(fallback).alias("is_fallback"),
        )

    def by_header(i: Column) -> Column:
        h, nxt = F.element_at("heads", i + 1), F.try_element_at(F.col("heads"), i + 2)
        start = F.when(i == 0, F.greatest(F.lit(0.0), h["y"] - 20)).otherwise(h["y"] - 8)
        foot = F.try_element_at(F.filter("feet", lambda f: (f["y"] > h["y"]) & (nxt.isNull() | (f["y"] < nxt["y"]))), F.lit(1))["y"]
        inner = F.coalesce(foot + 15, nxt["y"] - 5)
        last = F.least(F.col("height"), F.coalesce(foot + 25, F.col("max_y") + 15))
        end = F.when(nxt.isNotNull(), inner).otherwise(last)
        return region(i, start, end, start - 2, end + 2, h["text"], 0.95, False)

    def by_footer(i: Column) -> Column:
        start = F.coalesce(F.when(i > 0, F.try_element_at(F.col("feet"), i))["y"] + 20, F.lit(0.0))
        end = F.element_at("feet", i + 1)["y"] + 20
        return region(i, start, end, start, end, F.lit(None).cast("string"), 0.85, False)

    whole = region(F.lit(0), F.lit(0.0), F.col("height"), F.lit(float("-inf")), F.lit(float("inf")), F.lit(None).cast("string"), 1.0, True)

    def upto(arr: str) -> Column:
        return F.sequence(F.lit(0), F.size(arr) - 1)

    found = (
        F.when(F.size("heads") >= 2, F.transform(upto("heads"), by_header))
        .when(F.size("feet") >= 2, F.transform(upto("feet"), by_footer))
        .otherwise(F.array(whole))
    )
    return known.select(*PAGE, F.explode(found).alias("r")).select(*PAGE, "r.*")


def region_tokens(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Tokens with every region they lie in; regions may overlap."""
    listed = regions.groupBy(*PAGE).agg(F.collect_list(F.struct("index", "lo", "hi")).alias("regions"))
    inside = F.filter("regions", lambda r: (F.col("y") >= r["lo"]) & (F.col("y") <= r["hi"]))
    return tokens.join(listed.hint("shuffle_hash"), PAGE).withColumn("r", F.explode(inside)).select(*tokens.columns, F.col("r.index").alias("index"))


def complexity(tokens: DataFrame, keys: list[str], columns: int = 6, per_line: int = 7) -> DataFrame:
    """Distinct x columns (12 pt), tokens on the fullest line and the x range."""
    def fold(done: Column, x: Column) -> Column:
        return F.when(F.coalesce(x - done["last"] <= 12, F.lit(False)), done).otherwise(
            F.struct(x.alias("last"), (done["n"] + 1).alias("n"))
        )

    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))
    xs = tokens.groupBy(*keys).agg(
        F.aggregate(F.array_sort(F.collect_set("x")), start, fold)["n"].alias("col_count"),
        F.min("x").alias("x_min"), F.max(F.col("x") + F.coalesce("width", F.lit(0.0))).alias("x_max"),
    )
    lines = clustered_text(cluster_lines(tokens, keys), keys).groupBy(*keys).agg(F.max("n_items").alias("max_items_per_line"))
    df = xs.join(lines, keys, "left").na.fill(0, ["max_items_per_line"])
    return df.withColumn("is_complex", (F.col("col_count") >= columns) | (F.col("max_items_per_line") >= per_line))


def vertical_cut(tokens: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """x where a page is best cut in two: fewest boxes cut, then nearest the middle, then leftmost.

    Candidates stand two points apart around the middle. A box cuts a run of them, so it is one event where the run
    begins and one behind its end; between two events all candidates cut equally many boxes and the one
    nearest the middle is best. Work grows with the boxes, not with boxes times candidates.
    """
    pages = extents.select(*keys, "x_min", "x_max")
    span = F.col("x_max") - F.col("x_min")
    pages = pages.withColumns({"mid": F.col("x_min") + span / 2, "radius": span * 0.25}).withColumn("last", F.floor("radius"))

    def at(k: Column) -> Column:
        return F.col("mid") - F.col("radius") + k * 2

    left = F.coalesce("x", F.lit(0.0))
    width = F.when(F.col("width") > 0, F.col("width")).otherwise(20.0)
    boxes = tokens.select(*keys, (left + 1).alias("a"), (left + width - 1).alias("b")).join(pages, keys)
    first, behind = F.floor((F.col("a") - at(F.lit(0))) / 2), F.ceil((F.col("b") - at(F.lit(0))) / 2)
    # the guesses are put right by the comparison itself
    first = F.when(at(first) > F.col("a"), first).when(at(first + 1) > F.col("a"), first + 1).otherwise(first + 2)
    behind = F.when(at(behind - 1) >= F.col("b"), behind - 1).when(at(behind) >= F.col("b"), behind).otherwise(behind + 1)
    first, behind = F.greatest(first, F.lit(0)), F.least(behind, F.col("last") + 1)
    events = boxes.select(*keys, first.alias("first"), behind.alias("behind")).where("first < behind")
    events = events.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("k"), F.lit(1).alias("d")), F.struct(F.col("behind").alias("k"), F.lit(-1).alias("d")))))
    events = events.union(pages.select(*keys, F.lit(0).cast("bigint"), F.lit(0))).groupBy(*keys, "k").agg(F.sum("d").alias("d"))
    along = Window.partitionBy(*keys).orderBy("k")
    runs = events.withColumns({"cuts": F.sum("d").over(along), "next": F.lead("k").over(along)}).join(pages, keys)
    end = F.least(F.coalesce(F.col("next") - 1, F.col("last")), F.col("last"))
    runs = runs.withColumn("end", end).where("k <= end")
    middle = F.floor(F.col("radius") / 2)
    ks = F.array(*[F.greatest("k", F.least("end", middle + i)) for i in (0, 1)])
    scored = runs.select(*keys, "x_min", "x_max", "mid", "radius", "cuts", F.explode(ks).alias("c"))
    x = at(F.col("c"))
    score = F.struct((F.col("cuts") * 1000 + F.abs(x - F.col("mid"))).alias("score"), F.col("c").alias("k"), x.alias("x"))
    best = scored.groupBy(*keys, "x_min", "x_max").agg(F.min(score).alias("best"))
    return best.select(*keys, "x_min", "x_max", (F.floor(F.col("best.x") * 100 + 0.5) / 100).alias("x_cut"))


def split_halves(tokens: DataFrame, cuts: DataFrame, keys: list[str], overlap: float = 20.0) -> DataFrame:
    """Tokens of the left and the right half; tokens near the cut belong to both."""
    df = tokens.join(cuts, keys)
    right_edge = F.col("x") + F.coalesce("width", F.lit(0.0))
    sides = F.array(
        F.when(F.col("x") <= F.col("x_cut") + overlap, "left"), F.when(right_edge >= F.col("x_cut") - overlap, "right")
    )
    return df.withColumn("sub_index", F.explode(F.array_compact(sides))).drop("x_min", "x_max")


def processing_units(tokens: DataFrame, pages: DataFrame, page_text: DataFrame) -> DataFrame:
    """Work units of standard pages with text, density and payroll type: one per region where there are several, else the page.

    ``source_region`` names the region of the page that a unit comes from, null for whole pages.
    """
    regions = payslip_regions(tokens, pages)
    n = Window.partitionBy(*PAGE)
    counted = regions.withColumn("n", F.count("*").over(n))
    several = counted.where((F.col("n") > 1) & ~F.col("is_fallback"))
    keys = [*PAGE, "index"]
    density = ["char_count", "element_count", "line_count", "is_sparse", "is_scanned"]
    keyed = region_tokens(tokens, several)
    parts = several.select(*keys).join(spatial_text(keyed, keys), keys, "left").join(page_density(keyed, several, keys), keys).select(
        *keys, F.concat(F.lit("page:"), "page", F.lit(":region:"), "index").alias("result_key"), F.concat(F.lit("region:"), "index").alias("source_region"),
        F.coalesce("text", F.lit("")).alias("text"), *density,
    )
    whole = counted.where(F.col("n") == 1).select(*PAGE)
    single = whole.join(page_text, PAGE, "left").join(page_density(tokens, whole), PAGE).select(
        *PAGE, F.lit(None).cast("int").alias("index"), F.concat(F.lit("page:"), "page").alias("result_key"), F.lit(None).cast("string").alias("source_region"),
        F.coalesce("text", F.lit("")).alias("text"), *density,
    )
    return parts.unionByName(single).withColumn("payroll_type", standard_payroll_type(F.col("text")))
