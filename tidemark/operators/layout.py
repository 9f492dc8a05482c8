"""Layout of sheets given as cells(sheet, row, col, value, kind), rows and columns from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import BENCHMARK_WORDS, classify_sheet_header, column_letter, has_any, normalize_header, parse_date, parse_number, return_header_base

HEAD_ROWS, HEAD_COLUMNS = 30, 80
# Words of a total row, normalised.
TOTAL = ("累计", "合计", "total", "cumulative")


def to_cells(wide: DataFrame, sheet: Column, row: str, columns: list[str]) -> DataFrame:
    """Wide table to cells; blank cells are dropped."""
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    long = wide.select(sheet.alias("sheet"), F.col(row).cast("int").alias("row"), F.inline(F.filter(pairs, lambda x: x["value"].isNotNull() & (F.trim(x["value"]) != ""))))
    return long.withColumn("kind", F.lit("value"))


def header_cells(cells: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Cells of the first rows and columns with their role (null without one). routes: sheet, display_name (of the
    sheet's benchmark), if there are any."""
    top = cells.where((F.col("row") <= HEAD_ROWS) & (F.col("col") <= HEAD_COLUMNS))
    if routes is None:
        return top.withColumn("role", classify_sheet_header("value")).withColumn("display_name", F.lit(None).cast("string"))
    shown = routes.groupBy("sheet").agg(F.max("display_name").alias("display_name"))
    return top.join(shown, "sheet", "left").withColumn("role", classify_sheet_header("value", F.col("display_name")))


def detect_layout(cells: DataFrame, overrides: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """sheet, header_row, role, col: the header row has the most roles (3 more if it has date and unit), the first among
    equals; the first column of a role counts. overrides (sheet, role, col) win over what is found. Sheets without date
    and unit have no rows; see layout_errors."""
    h = header_cells(cells, routes).where(F.col("role").isNotNull())
    rows = h.groupBy("sheet", "row").agg(F.count_distinct("role").alias("n"), F.bool_or(F.col("role") == "date").alias("d"), F.bool_or(F.col("role") == "unit").alias("u"))
    rows = rows.withColumn("score", F.col("n") + F.when(F.col("d") & F.col("u"), 3).otherwise(0))
    best = rows.groupBy("sheet").agg(F.min_by("row", F.struct(-F.col("score"), F.col("row"))).alias("row"))
    found = h.join(best, ["sheet", "row"]).groupBy("sheet", F.col("row").alias("header_row"), "role").agg(F.min("col").alias("col"))
    if overrides is not None:
        given = overrides.select("sheet", "role", F.col("col").alias("_given"))
        at = found.select("sheet", "header_row").distinct()
        found = found.join(given, ["sheet", "role"], "full_outer").join(at.withColumnRenamed("header_row", "_at"), "sheet")
        found = found.select("sheet", F.col("_at").alias("header_row"), "role", F.coalesce("_given", "col").alias("col"))
    whole = found.groupBy("sheet").agg(F.count_if(F.col("role").isin("date", "unit")).alias("n")).where("n = 2").select("sheet")
    return found.join(whole, "sheet", "left_semi")


def layout_errors(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """sheet, issue: sheets whose header has no date or no unit column."""
    return cells.select("sheet").distinct().join(layout.select("sheet").distinct(), "sheet", "left_anti").withColumn("issue", F.lit("date-or-unit-missing"))


def pair_benchmark_columns(cells: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Return and level column of a named index per header row: sheet, row, level_col (null if none), return_col.

    A return header that isn't another role's pairs with the unused column whose header is what is left of it without
    its words for returns. It needs a word for an index or the display name, or an excess column and a level column.
    The first such return column counts; rows that have both roles already are left out."""
    h = header_cells(cells, routes).withColumns({"name": normalize_header("value"), "base": return_header_base("value")})
    row = Window.partitionBy("sheet", "row")
    has = lambda r: F.coalesce(F.bool_or(F.col("role") == r).over(row), F.lit(False))
    h = h.withColumns({"has_return": has("benchmark_return"), "has_level": has("benchmark_level"), "has_excess": has("excess")})
    shown = normalize_header(F.coalesce("display_name", F.lit("")))
    named = has_any(F.col("name"), BENCHMARK_WORDS) | ((shown != "") & F.col("name").contains(shown))
    free = F.when(F.col("has_return"), F.col("role") == "benchmark_return").otherwise(F.col("role").isNull() | F.col("role").isin("daily_return", "weekly_return", "return"))
    back = h.where(~(F.col("has_return") & F.col("has_level")) & F.coalesce(free, F.lit(False)) & (F.col("base") != "") & (F.col("base") != F.col("name")))
    back = back.select("sheet", "row", F.col("col").alias("return_col"), F.col("base").alias("name"), named.alias("named"), "has_excess")
    level = h.where(F.col("role").isNull()).groupBy("sheet", "row", "name").agg(F.min("col").alias("level_col"))
    pairs = back.join(level, ["sheet", "row", "name"], "left").where(F.col("named") | (F.col("has_excess") & F.col("level_col").isNotNull()))
    first = F.min_by(F.struct("level_col", "return_col"), "return_col").alias("p")
    return pairs.groupBy("sheet", "row").agg(first).select("sheet", "row", "p.level_col", "p.return_col")


def dated_cells(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """sheet, row, role, value of body cells in known columns."""
    return cells.join(layout, ["sheet", "col"]).where(F.col("row") > F.col("header_row")).select("sheet", "row", "role", "value")


def cells_to_history(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Typed rows of the dated lines: sheet, row_no, nav_date, unit, cumulative, code."""
    value = lambda role: F.max(F.when(F.col("role") == role, F.col("value")))
    wide = dated_cells(cells, layout).groupBy("sheet", F.col("row").alias("row_no")).agg(value("date").alias("d"), value("unit").alias("u"), value("cumulative").alias("c"), value("code").alias("code"))
    return wide.select("sheet", "row_no", parse_date("d").alias("nav_date"), parse_number("u").alias("unit"), parse_number("c").alias("cumulative"), "code").where(F.col("nav_date").isNotNull())


def find_total_row(cells: DataFrame, history: DataFrame) -> DataFrame:
    """sheet, total_row, placed: the first row after the last dated one that is headed by a total word in one of its
    first six columns, and whether it directly follows."""
    last = history.groupBy("sheet").agg(F.max("row_no").alias("last"))
    words = cells.where((F.col("col") <= 6) & normalize_header("value").isin(*TOTAL)).select("sheet", "row")
    found = words.join(last, "sheet").where(F.col("row") > F.col("last")).groupBy("sheet", "last").agg(F.min("row").alias("total_row"))
    return found.select("sheet", "total_row", (F.col("total_row") == F.col("last") + 1).alias("placed"))


def check_mode(layout: DataFrame, totals: DataFrame, history: DataFrame, routes: DataFrame) -> DataFrame:
    """sheet, issue: what a route's sheet mode needs and the sheet lacks. routes: sheet, sheet_mode and, if there are any,
    return_frequency and has_benchmark (its benchmark and excess columns must be there then)."""
    for c, kind in (("return_frequency", "string"), ("has_benchmark", "boolean")):
        routes = routes if c in routes.columns else routes.withColumn(c, F.lit(None).cast(kind))
    has = layout.groupBy("sheet").agg(F.collect_set("role").alias("roles"))
    dated = history.groupBy("sheet").agg(F.count("*").alias("dated"))
    rows = routes.select("sheet", F.coalesce("sheet_mode", F.lit("summary")).alias("mode"), "return_frequency", F.coalesce("has_benchmark", F.lit(False)).alias("has_benchmark")).join(has, "sheet", "left").join(totals.select("sheet", "placed"), "sheet", "left").join(dated, "sheet", "left")
    role = lambda r: F.coalesce(F.array_contains("roles", r), F.lit(False))
    issue = (
        F.when(F.col("roles").isNull(), "no-header")
        .when((F.col("mode") == "append") & F.col("placed").isNotNull(), "append-with-footer")
        .when((F.col("mode") == "append") & ~role("code") & ~role("name"), "append-without-identity")
        .when((F.col("mode") == "summary") & F.col("dated").isNull(), "summary-without-rows")
        .when((F.col("mode") == "summary") & ~F.coalesce("placed", F.lit(False)), "summary-without-total")
        .when((F.col("mode") == "template") & F.col("return_frequency").isNull(), "template-without-frequency")
        .when((F.col("mode") == "template") & ~role("return") & ~role("daily_return") & ~role("weekly_return"), "template-without-return")
        .when((F.col("mode") == "template") & F.col("has_benchmark") & ~(role("benchmark_return") & role("excess")), "template-without-benchmark")
    )
    return rows.select("sheet", issue.alias("issue")).where(F.col("issue").isNotNull())


def reserved_row(history: DataFrame, totals: DataFrame, cells: DataFrame | None = None, layout: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """sheet, row_no, nav_date of a single dated row directly above the total with a blank value: a placeholder. With
    cells and layout nothing but date, identity and values may be filled in it; with routes its code must be theirs."""
    per = history.groupBy("sheet").agg(F.count("*").alias("n"), F.max("row_no").alias("row_no"), F.max("nav_date").alias("nav_date"), F.first("code").alias("code"), F.bool_or(F.col("unit").isNull() | F.col("cumulative").isNull()).alias("blank"))
    rows = per.join(totals.where("placed"), "sheet").where((F.col("n") == 1) & F.col("blank"))
    if cells is not None and layout is not None:
        own = layout.where(F.col("role").isin("date", "code", "name", "unit", "cumulative")).select("sheet", "col")
        other = cells.join(own, ["sheet", "col"], "left_anti").select("sheet", F.col("row").alias("row_no")).distinct()
        rows = rows.join(other, ["sheet", "row_no"], "left_anti")
    if routes is not None:
        rows = rows.join(routes.select("sheet", F.col("code").alias("expected")), "sheet").where(F.coalesce(F.col("code") == F.col("expected"), F.lit(True)))
    return rows.select("sheet", "row_no", "nav_date")


def column_roles(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """sheet, role, letter, header."""
    return layout.join(cells.select("sheet", F.col("row").alias("header_row"), "col", "value"), ["sheet", "header_row", "col"]).select("sheet", "role", column_letter("col").alias("letter"), F.col("value").alias("header"))


def infer_adoption(layout: DataFrame, history: DataFrame, totals: DataFrame, frequency: DataFrame, cands: DataFrame, cells: DataFrame) -> DataFrame:
    """Proposed route per sheet: mode, code, name, frequency, series_start (a day after the last row), cumulative policy
    (require if all candidates carry the value, else unit if history's equals the unit value, else ambiguous), and
    benchmark_review (a benchmark or excess column holds values)."""
    h = history.groupBy("sheet").agg(F.max("nav_date").alias("last"), F.when(F.count_distinct("code") == 1, F.min("code")).alias("code"), F.bool_and(F.abs(F.col("unit") - F.col("cumulative")) <= 1e-9).alias("same"))
    c = cands.groupBy("sheet").agg(F.bool_and(F.col("cumulative").isNotNull()).alias("carries"))
    body = dated_cells(cells, layout)
    names = body.where("role = 'name'").groupBy("sheet").agg(F.when(F.count_distinct("value") == 1, F.min("value")).alias("name"))
    review = body.where(F.col("role").isin("benchmark_level", "benchmark_return", "excess")).select("sheet", F.lit(True).alias("review")).distinct()
    policy = F.when(F.col("carries"), "require").when(F.col("same"), "unit").otherwise("ambiguous")
    rows = h
    for part in (c, totals.select("sheet", "placed"), frequency.select("sheet", "frequency"), names, review):
        rows = rows.join(part, "sheet", "left")
    mode = F.when(F.coalesce("placed", F.lit(False)), "summary").otherwise("append")
    return rows.select("sheet", mode.alias("mode"), "code", "name", "frequency", F.date_add("last", 1).alias("series_start"), policy.alias("cumulative_policy"), F.coalesce("review", F.lit(False)).alias("benchmark_review"))
