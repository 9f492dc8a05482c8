"""Constraints on routes, reviews, benchmark sources and options: rows name what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import normalize_code, parse_date
from tidemark.operators.routing import accepted_codes

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# Allowed settings.
MODES, POLICIES, BASES = ("append", "summary", "template"), ("require", "unit", "offset"), ("unit", "cumulative")
RETURN_FREQUENCIES, DATA_FREQUENCIES, OVERLAP = ("daily", "weekly"), ("auto", "daily", "weekly"), "last_existing_point"
MAX_CODE = 64
REVIEW_STATUSES = ("excluded", "parser-required", "business-review", "no-evidence", "reference")
BOUNDS = {"minimum_history_dates": (2, 100), "tolerance": (0.0, 0.01), "max_future_days": (0, 7), "max_period_change": (0.001, 10.0), "zero_threshold": (0.0, 0.1), "backup_count": (1, 100), "preview_count": (1, 100), "log_days": (1, 3650)}


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def uniqueness(routes: DataFrame) -> DataFrame:
    """sheet, rule: one route a sheet; a code once a sender (aliases too); senders with several routes need codes and no
    sender-only route."""
    twice = routes.groupBy("sheet").agg(F.count("*").alias("n")).where("n > 1").select("sheet", F.lit("one-route-per-sheet").alias("rule"))
    codes = accepted_codes(routes).groupBy("sender", "accepted").agg(F.count_distinct("sheet").alias("n"), F.min("sheet").alias("sheet")).where("n > 1").select("sheet", F.lit("code-once-per-sender").alias("rule"))
    many = routes.groupBy("sender").agg(F.count("*").alias("n")).where("n > 1").select("sender")
    shared = routes.join(many, "sender", "left_semi")
    bare = shared.where(F.col("code").isNull() | F.coalesce("allow_sender_only", F.lit(False))).select("sheet", F.lit("shared-sender-needs-code").alias("rule"))
    return union_all([twice, codes, bare])


def optional(df: DataFrame, name: str) -> Column:
    """A text column, null where the table lacks it."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def route_rules(routes: DataFrame) -> DataFrame:
    """sheet, rule: one row per broken rule. One pass: all rules are evaluated on the row. return_basis, data_frequency,
    series_start_text (the date as written), baseline_overlap and subject_product_code may be absent."""
    c = F.col
    aliases = F.coalesce("code_aliases", F.array().cast("array<string>"))
    rules = {
        "sender-address": ~c("sender").rlike(EMAIL),
        "sheet-name": (F.length("sheet") < 1) | (F.length("sheet") > 31),
        "alias-repeated": (F.size(aliases) != F.size(F.array_distinct(aliases))) | F.array_contains(aliases, c("code")),
        "pause-reason": F.coalesce(c("paused"), F.lit(False)) & (F.coalesce(c("pause_reason"), F.lit("")) == ""),
        "staleness-range": ~c("max_staleness_days").between(1, 366),
        "mode": ~F.coalesce(c("sheet_mode"), F.lit("summary")).isin(*MODES),
        "policy": ~F.coalesce(c("cumulative_policy"), F.lit("require")).isin(*POLICIES),
        "offset-missing": (c("cumulative_policy") == "offset") & c("cumulative_offset").isNull(),
        "return-basis": ~F.coalesce(optional(routes, "return_basis"), F.lit("unit")).isin(*BASES),
        "data-frequency": ~F.coalesce(optional(routes, "data_frequency"), F.lit("auto")).isin(*DATA_FREQUENCIES),
        "series-start": optional(routes, "series_start_text").isNotNull() & parse_date(optional(routes, "series_start_text")).isNull(),
        "baseline-overlap": optional(routes, "baseline_overlap") != OVERLAP,
        "binding-code": optional(routes, "subject_product_code").isNotNull() & (F.coalesce(normalize_code(optional(routes, "subject_product_code")), F.lit("")) != F.coalesce(normalize_code(c("code")), F.lit(""))),
        "code-length": F.length("code") > MAX_CODE,
        "template-frequency": (c("sheet_mode") == "template") & ~F.coalesce(c("return_frequency"), F.lit("")).isin(*RETURN_FREQUENCIES),
    }
    return broken_rules(routes, rules)


def benchmark_rules(routes: DataFrame) -> DataFrame:
    """sheet, rule. Columns: benchmark (a struct as in FIXTURES.md), benchmark_review_only, sheet_mode. The struct is
    taken apart into columns first, and once."""
    fields = ("source_sheet", "source_type", "source_date", "source_value", "technical_source_verified", "license_source", "license_approved_by")
    flat = routes.select("sheet", F.coalesce("sheet_mode", F.lit("summary")).alias("mode"), F.coalesce("benchmark_review_only", F.lit(False)).alias("review"), F.col("benchmark").isNotNull().alias("has"), *[F.col("benchmark")[f].alias(f) for f in fields])
    given = sum((F.col(f).isNotNull().cast("int") for f in fields[5:]), F.col(fields[4]).isNotNull().cast("int"))
    rules = {
        "benchmark-fields": F.col("has") & (F.col("source_sheet").isNull() | F.col("source_date").isNull() | F.col("source_value").isNull()),
        "benchmark-type": F.col("has") & ~F.coalesce("source_type", F.lit("level")).isin("level", "aligned_return"),
        "benchmark-provenance": F.col("has") & given.between(1, 2),
        "review-with-benchmark": F.col("has") & F.col("review"),
        "review-needs-summary": F.col("review") & (F.col("mode") != "summary"),
    }
    return broken_rules(flat, rules)


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """sheet, rule of the rules that hold on a row."""
    named = rows.select("sheet", *[F.coalesce(rule, F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    found = F.array_compact(F.array(*[F.when(F.col(f"r{i}"), F.lit(name)) for i, name in enumerate(rules)]))
    return named.select("sheet", F.explode(found).alias("rule"))


def review_rules(reviews: DataFrame, routes: DataFrame) -> DataFrame:
    managed = reviews.join(routes.select("sheet").distinct(), "sheet", "left_semi").select("sheet", F.lit("review-on-managed-sheet").alias("rule"))
    status = reviews.where(~F.coalesce("status", F.lit("")).isin(*REVIEW_STATUSES)).select("sheet", F.lit("review-status").alias("rule"))
    reason = reviews.where(F.coalesce("reason", F.lit("")).rlike(r"[\r\n]") | (F.length(F.coalesce("reason", F.lit(""))) > 200)).select("sheet", F.lit("review-reason").alias("rule"))
    return union_all([managed, status, reason])


def shared_benchmark_sources(routes: DataFrame) -> DataFrame:
    """source_sheet, definitions of sources that are defined in more than one way."""
    rows = routes.where(F.col("benchmark").isNotNull()).select("benchmark.*")
    return rows.groupBy("source_sheet").agg(F.count_distinct(F.to_json(F.struct("source_type", "source_date", "source_value"))).alias("definitions")).where("definitions > 1")


def option_bounds(options: DataFrame) -> DataFrame:
    """option, value, low, high of options(option, value) out of bounds; tolerance 0 is out too, and an unknown option is
    out of null bounds."""
    known = F.create_map(*[x for k, (a, b) in BOUNDS.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")))])
    rows = options.select("option", F.col("value").cast("double").alias("value"), F.try_element_at(known, F.col("option")).alias("b"))
    bad = F.col("b").isNull() | ~F.coalesce(F.col("value").between(F.col("b.low"), F.col("b.high")), F.lit(False)) | ((F.col("option") == "tolerance") & (F.col("value") <= 0))
    return rows.where(bad).select("option", "value", "b.low", "b.high")
