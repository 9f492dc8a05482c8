"""Filters and classes over messages and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import has_any

# Words of subjects, without white space and in lower case.
NAV_WORDS = ("净值", "unitnav", "unitvalue")
VIRTUAL = ("虚拟估算", "模拟估算", "净值估算", "估算净值", "estimatednav", "navestimate")
CONFIRMATION = ("交易确认", "成交确认", "申购确认", "赎回确认", "tradeconfirmation", "transactionconfirmation")
PERIODIC = ("月报", "季报", "monthlyreport", "quarterlyreport")
NO_CORRECTION = ("无需更正", "不作更正", "不用更正", "非更正", "未更正", "更正前", "修正前")
AUTHORITATIVE = ("以此为准", "以本邮件为准", "以本通知为准", "更正通知", "更正版", "净值更正", "数据更正", "修正通知", "修正版")
# Formats of attachments that are read.
SUPPORTED = ("xlsx", "xls", "csv", "txt", "pdf", "html")
# Limits of a source.
MAX_CHARS, MAX_TABLES, MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 2_000_000, 20, 20_000, 200, 2_000_000


def lookback(df: DataFrame, as_of: Column, days: int, date: str = "sent_at") -> DataFrame:
    """Rows since as_of less days; days from 1 to 3650."""
    if not 1 <= days <= 3650:
        raise ValueError("days must be from 1 to 3650")
    return df.where(F.col(date) >= F.date_sub(as_of, days))


def senders(raw) -> Column:
    """Distinct lower-case addresses of a From header."""
    found = F.regexp_extract_all(raw if isinstance(raw, Column) else F.col(raw), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def exact_sender(raw) -> Column:
    """The one address of a From header; null if there is none or several."""
    s = senders(raw)
    return F.when(F.size(s) == 1, F.get(s, F.lit(0)))


def subject_in_scope(subject: Column, contains: Column, excludes: Column) -> Column:
    """Holds `contains` (case aside; null or empty holds always) and none of `excludes`."""
    low = F.lower(F.coalesce(subject, F.lit("")))
    within = F.coalesce(contains, F.lit("")) == ""
    banned = F.exists(F.coalesce(excludes, F.array().cast("array<string>")), lambda x: (F.length(x) > 0) & low.contains(F.lower(x)))
    return (within | low.contains(F.lower(contains))) & ~banned


def compact(subject: Column) -> Column:
    return F.lower(F.regexp_replace(subject, r"(?U)\s+", ""))


def nav_signal(subject: Column) -> Column:
    """Whether a subject speaks of a net asset value."""
    return has_any(compact(subject), NAV_WORDS) | F.lower(subject).rlike(r"(?U)\bnav\b")


def non_nav_category(subject: Column) -> Column:
    """Estimates always have one; confirmations and periodic reports only without a NAV signal."""
    said, signal = compact(subject), nav_signal(subject)
    return F.when(has_any(said, VIRTUAL), "virtual-estimate").when(~signal & has_any(said, CONFIRMATION), "transaction-confirmation").when(~signal & has_any(said, PERIODIC), "periodic-report")


def notice_classification(subject: Column, suffixes: Column) -> Column:
    """Why a message gave no rows: its category, likely not a notice (no signal and no supported attachment), or a gap of
    the parser."""
    supported = F.exists(F.coalesce(suffixes, F.array().cast("array<string>")), lambda s: F.lower(s).isin(*SUPPORTED))
    return F.coalesce(non_nav_category(subject), F.when(~nav_signal(subject) & ~supported, "likely-non-nav-notice").otherwise("nav-parser-gap"))


def correction_marker(subject: Column) -> Column:
    """authoritative, correction or null, by the first words that are found: denials, authoritative phrases, words."""
    said = compact(subject)
    words = said.rlike("(?<!非)(更正|修正)") | F.lower(subject).rlike(r"(?U)\b(corrected|correction|revised|revision)\b")
    return F.when(has_any(said, NO_CORRECTION), None).when(has_any(said, AUTHORITATIVE), "authoritative").when(words, "correction")


def active_routes(routes: DataFrame) -> DataFrame:
    return routes.where(~F.coalesce("paused", F.lit(False)))


def paused_routes(routes: DataFrame) -> DataFrame:
    return routes.where(F.coalesce("paused", F.lit(False))).select("sheet", F.coalesce("pause_reason", F.lit("")).alias("reason"))


def split_at_series_start(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds managed: on or after the route's series_start, or without one."""
    starts = routes.select("sheet", "series_start")
    return df.join(starts, "sheet", "left").withColumn("managed", F.col("series_start").isNull() | (F.col("nav_date") >= F.col("series_start"))).drop("series_start")


def scope_to_sheets(routes: DataFrame, sheets: list[str]) -> tuple[DataFrame, DataFrame]:
    """Active routes of the named sheets, and the names that no active route has (errors)."""
    named = routes.sparkSession.createDataFrame([(s,) for s in sheets], "sheet string")
    active = active_routes(routes)
    return active.join(named, "sheet", "left_semi"), named.join(active, "sheet", "left_anti")


def bounded_batch(df: DataFrame, batch: int, max_each: int, max_total: int, key: str, before_uid: int | None = None) -> DataFrame:
    """Newest first per mailbox `key`: messages over max_each are passed over, and the batch stops at `batch` messages or
    where their sizes would pass max_total. Adds taken and oversize."""
    rows = df if before_uid is None else df.where(F.col("uid") < before_uid)
    rows = rows.withColumn("oversize", F.col("size") > max_each)
    w = Window.partitionBy(key).orderBy(F.desc("uid"))
    n = F.row_number().over(w)
    running = F.sum(F.when(~F.col("oversize"), F.col("size")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_n": n, "_sum": running}).withColumn("taken", (F.col("_n") <= batch) & (F.col("_sum") <= max_total) & ~F.col("oversize")).drop("_n", "_sum")


def batch_cursor(batch: DataFrame, key: str) -> DataFrame:
    """Per mailbox: next_before (least uid handled), complete (everything was taken or oversize)."""
    return batch.groupBy(key).agg(F.min(F.when(F.col("taken"), F.col("uid"))).alias("next_before"), F.bool_and(F.col("taken") | F.col("oversize")).alias("complete"), F.count_if("taken").alias("taken"))


def resource_guard(df: DataFrame, text_col: str, size_col: str | None = None) -> DataFrame:
    """Adds reject: the limit that a text breaks, or null. Lines are measured in one pass; tables are counted by their
    opening tags. Only texts within the limit of characters are looked into. size_col: their characters where these are
    known beforehand, as of a source that declares its size; a larger text then needs not be there."""
    c = F.coalesce(text_col, F.lit(""))
    size = F.greatest(F.length(c), F.coalesce(size_col, F.lit(0))) if size_col else F.length(c)
    widths = F.transform(F.split(c, "\n"), lambda x: F.length(x) - F.length(F.translate(x, "|\t,;", "")) + 1)
    rows = df.withColumn("_widths", F.when(size <= MAX_CHARS, widths))
    lines, width = F.size("_widths"), F.array_max("_widths")
    cells = F.aggregate("_widths", F.lit(0).cast("long"), lambda total, x: total + x)
    tables = F.regexp_count(c, F.lit(r"(?i)<table\b"))
    reject = (
        F.when(size > MAX_CHARS, "too many characters")
        .when(tables > MAX_TABLES, "too many tables")
        .when(lines > MAX_ROWS, "too many rows")
        .when(width > MAX_COLUMNS, "too many columns")
        .when(cells > MAX_CELLS, "too many cells")
    )
    return rows.withColumn("reject", reject).drop("_widths")


def last_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_headers(msgs: DataFrame, k: int) -> DataFrame:
    """The newest k messages, newest first; truncated says whether there are more."""
    n = msgs.agg((F.count("*") > k).alias("truncated"))
    newest = msgs.orderBy(F.desc("sent_at"), F.desc("uid")).limit(k)
    return newest.join(F.broadcast(n), how="cross").orderBy(F.desc("sent_at"), F.desc("uid"))  # one row


def canonical_sort(obs: DataFrame) -> DataFrame:
    return obs.orderBy("nav_date", F.coalesce("code", F.lit("")), "unit")


def scope_union(msgs: DataFrame, filters: list[Column]) -> DataFrame:
    """Distinct ids of the messages that any filter takes. One scan with the filters joined by or."""
    any_of = F.lit(False)
    for f in filters:
        any_of = any_of | f
    return msgs.where(any_of).select("message_id").distinct()


def matched_dates(hist: DataFrame, cand: DataFrame) -> DataFrame:
    return hist.select("sheet", "nav_date").intersect(cand.select("sheet", "nav_date"))


def sheet_differences(sheets: DataFrame, routes: DataFrame, reviews: DataFrame) -> DataFrame:
    """sheet, issue: unmanaged (no route), missing (a route without sheet), orphan-review (a review without sheet)."""
    s, r, v = sheets.select("sheet").distinct(), routes.select("sheet").distinct(), reviews.select("sheet").distinct()
    parts = ((s.join(r, "sheet", "left_anti"), "unmanaged"), (r.join(s, "sheet", "left_anti"), "missing"), (v.join(s, "sheet", "left_anti"), "orphan-review"))
    out = None
    for part, issue in parts:
        part = part.withColumn("issue", F.lit(issue))
        out = part if out is None else out.union(part)
    return out
