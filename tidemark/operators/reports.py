"""Reports: per sender, route, sheet and run. Lists in them are bounded before they are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.operators.cadence import infer_frequency, pending_week_baseline, select_for_frequency, withheld_current_week
from tidemark.operators.filters import exact_sender
from tidemark.operators.routing import applicable


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def propose_candidates(obs: DataFrame, sample: int = 100, messages: DataFrame | None = None, arrivals: int = 20, subjects: int = 10) -> DataFrame:
    """Per sender: messages, distinct codes, first and last date, and the newest distinct observations; with messages
    (message_id, sender, subject, sent_at) also the newest arrival times and the first subjects in order."""
    per = obs.groupBy("sender").agg(F.count_distinct("message_id").alias("messages"), F.array_sort(F.collect_set("code")).alias("codes"), F.min("nav_date").alias("first_date"), F.max("nav_date").alias("last_date"))
    newest = first_n(obs.select("sender", "nav_date", "code", "unit").distinct(), ["sender"], [F.desc("nav_date"), F.col("code"), F.col("unit")], sample)
    out = per.join(newest.groupBy("sender").agg(F.array_sort(F.collect_list(F.struct("nav_date", "code", "unit"))).alias("sample")), "sender")
    if messages is None:
        return out
    times = first_n(messages.select("sender", "sent_at").distinct(), ["sender"], [F.desc("sent_at")], arrivals).groupBy("sender").agg(F.sort_array(F.collect_list("sent_at"), asc=False).alias("arrivals"))
    said = first_n(messages.select("sender", "subject").distinct(), ["sender"], [F.col("subject")], subjects).groupBy("sender").agg(F.array_sort(F.collect_list("subject")).alias("subjects"))
    return out.join(times, "sender", "left").join(said, "sender", "left")


def propose_headers(headers: DataFrame, subjects: int = 20) -> DataFrame:
    """Per exact sender: messages and up to `subjects` subjects. Headers without exactly one sender are left out; see
    ignored_headers."""
    h = headers.withColumn("sender", exact_sender("from_raw")).where(F.col("sender").isNotNull())
    some = first_n(h.select("sender", "subject").distinct(), ["sender"], [F.col("subject")], subjects)
    return h.groupBy("sender").agg(F.count_distinct("message_id").alias("messages")).join(some.groupBy("sender").agg(F.array_sort(F.collect_list("subject")).alias("subjects")), "sender")


def ignored_headers(headers: DataFrame) -> DataFrame:
    return headers.where(exact_sender("from_raw").isNull()).agg(F.count("*").alias("ignored"))


def route_report(routed: DataFrame, messages: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Per sheet: messages, candidate dates, rows before the managed range; with messages (message_id, sender, subject) and
    routes also scanned (messages of the route's sender), filtered (of these, kept off by its subject conditions) and
    bindings (routes of the sheet)."""
    per = routed.where(F.col("sheet").isNotNull()).groupBy("sheet").agg(F.count_distinct("message_id").alias("messages"), F.count_distinct(F.when(F.col("outcome") == "routed", F.col("nav_date"))).alias("dates"), F.count_if(F.col("outcome") == "pre_managed").alias("pre_managed"))
    if messages is None or routes is None:
        return per
    kinds = messages.groupBy("sender", F.coalesce("subject", F.lit("")).alias("subject")).agg(F.count_distinct("message_id").alias("n"))
    seen = kinds.join(routes.select("sender", "sheet"), "sender").groupBy("sheet").agg(F.sum("n").alias("scanned"))
    kept = applicable(messages, routes).select("sender", "subject", "sheet").join(kinds, ["sender", "subject"]).groupBy("sheet").agg(F.sum("n").alias("_kept"))
    bound = routes.groupBy("sheet").agg(F.count("*").alias("bindings"))
    rows = bound.join(seen, "sheet", "left").join(kept, "sheet", "left").join(per, "sheet", "left").fillna(0)
    return rows.select("sheet", "messages", "dates", "pre_managed", "scanned", (F.col("scanned") - F.col("_kept")).alias("filtered"), "bindings")


def parse_gap_summary(messages: DataFrame, obs: DataFrame) -> DataFrame:
    """Per sender: headers, messages without rows, rows; gap where nothing at all was parsed; where messages have bodies
    and attachments also how many have a text and an HTML body, and the number of attachments by type."""
    per = obs.groupBy("message_id").agg(F.count("*").alias("_rows"))
    joined = messages.join(per, "message_id", "left")
    filled = lambda c: F.count_if(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0)
    bodies = [filled(c).alias(f"with_{c}") for c in ("plain", "html") if c in messages.columns]
    rows = joined.groupBy("sender").agg(F.count("*").alias("headers_matched"), F.count_if(F.col("_rows").isNull()).alias("without_rows"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("parsed_rows"), *bodies)
    rows = rows.withColumn("gap", F.col("parsed_rows") == 0)
    if "attachments" not in messages.columns:
        return rows
    files = messages.select("sender", F.explode("attachments").alias("a")).groupBy("sender", F.col("a.content_type").alias("type")).agg(F.count("*").alias("n"))
    types = files.groupBy("sender").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("attachment_types"))  # an entry per type
    return rows.join(types, "sender", "left")


def warning_summary(warnings: DataFrame, keys: list[str]) -> DataFrame:
    return warnings.groupBy(*keys).agg(F.count("*").alias("n"))


def merge_warning_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


def attachment_metadata(messages: DataFrame) -> DataFrame:
    a = messages.select("message_id", F.explode("attachments").alias("a"))
    return a.groupBy("message_id", F.col("a.suffix").alias("suffix"), F.col("a.content_type").alias("content_type")).agg(F.count("*").alias("n"), F.count_distinct("a.name").alias("n_names"))


def exclusion_counts(messages: DataFrame, routes: DataFrame | None = None, max_size: int | None = None) -> DataFrame:
    """Messages by the reason for which they were rejected; a reason counts once a message. Reasons are a column, or with
    routes are found: `subject` (the sender has routes, but no route's subject conditions hold), `too-large` (over
    max_size), `paused` (only paused routes apply)."""
    if routes is not None:
        known = routes.select("sender").distinct().withColumn("_known", F.lit(True))
        apply = applicable(messages, routes).groupBy("sender", "subject").agg(F.bool_or(~F.coalesce("paused", F.lit(False))).alias("_active"))
        rows = messages.withColumn("subject", F.coalesce("subject", F.lit(""))).join(known, "sender").join(apply, ["sender", "subject"], "left")
        large = F.col("size") > F.lit(max_size) if max_size is not None else F.lit(False)
        found = F.array(F.when(F.col("_active").isNull(), F.lit("subject")), F.when(~F.col("_active"), F.lit("paused")), F.when(large, F.lit("too-large")))
        messages = rows.withColumn("reasons", F.array_compact(found))
    return messages.select("message_id", F.explode(F.array_distinct("reasons")).alias("reason")).groupBy("reason").agg(F.count_distinct("message_id").alias("messages"))


def staleness_check(obs: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    """sheet, latest, issue: stale (older than max_staleness_days), no-rows, or null."""
    latest = obs.groupBy("sheet").agg(F.max("nav_date").alias("latest"))
    rows = routes.select("sheet", "max_staleness_days").join(latest, "sheet", "left")
    issue = F.when(F.col("latest").isNull(), "no-rows").when(F.col("latest") < F.date_sub(as_of, F.col("max_staleness_days")), "stale")
    return rows.select("sheet", "latest", issue.alias("issue"))


def scope_fingerprint(messages: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per key: number of rows and an order-free fingerprint (xor and sum of row hashes, hashed)."""
    h = F.xxhash64(*cols)
    per = messages.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return per.select(key, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"))


def baseline_report(cand: DataFrame, hist: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Per sheet: matched dates, last date of history and of the source, dates pending after history's end; with as_of
    also withheld, the dates of the current week that weekly selection holds back."""
    h = hist.groupBy("sheet").agg(F.max("nav_date").alias("history_latest"))
    rows = cand.join(hist.select("sheet", "nav_date").withColumn("known", F.lit(True)), ["sheet", "nav_date"], "left").join(h, "sheet", "left")
    per = rows.groupBy("sheet", "history_latest").agg(F.count_if(F.coalesce("known", F.lit(False))).alias("matched"), F.max("nav_date").alias("source_latest"), F.count_if(F.col("known").isNull() & (F.col("nav_date") > F.col("history_latest"))).alias("pending"))
    if as_of is None:
        return per
    held = withheld_current_week(cand, hist, as_of).groupBy("sheet").agg(F.array_sort(F.collect_set("nav_date")).alias("withheld"))  # a week's dates
    return per.join(held, "sheet", "left").withColumn("withheld", F.coalesce("withheld", F.array().cast("array<date>")))


def validation_facts(cand: DataFrame, hist: DataFrame, routes: DataFrame, pre: DataFrame, reserved: DataFrame, as_of: Column) -> DataFrame:
    """What validation_report needs per sheet of the candidates, from the data: matches and conflicts with history, dates
    that the sheet's cadence selects, a reserved row, a pending week, a verified boundary anchor, managed rows of
    history, onboarding (identity is proven and history is complete), and candidates with errors.

    routes: sheet, mode, code, product_name, series_start, baseline_overlap, max_staleness_days; pre: candidates before
    series_start; reserved: sheet."""
    status = reconcile.match_history(cand, hist, routes=routes).groupBy("sheet").agg(F.count_if(F.col("status") == "matched").alias("matches"), F.count_if(F.col("status") == "conflict").alias("conflicts"))
    chosen = select_for_frequency(cand, hist, infer_frequency(hist), as_of)
    selected = reconcile.new_rows(chosen, hist).groupBy("sheet").agg(F.count("*").alias("selected"))
    at = routes.select("sheet", as_of.alias("as_of"), "max_staleness_days")
    pending = pending_week_baseline(cand, hist, at).select("sheet", F.col("pending").alias("pending_week"))
    anchor = reconcile.verify_boundary_anchor(pre, hist, routes).select("sheet", F.col("verified").alias("boundary"))
    starts = hist.join(routes.select("sheet", "series_start"), "sheet", "left")
    managed = starts.groupBy("sheet").agg(F.count_if(F.col("series_start").isNull() | (F.col("nav_date") >= F.col("series_start"))).alias("managed"), F.bool_and(F.col("unit").isNotNull() & F.col("cumulative").isNotNull()).alias("_full"))
    proven = reconcile.identity_evidence(hist, cand, routes)
    errors = reconcile.candidate_checks(cand, routes, as_of).groupBy("sheet").agg(F.count("*").alias("errors"))
    rows = cand.select("sheet").distinct().join(routes.select("sheet", "mode"), "sheet")
    for part in (status, selected, pending, anchor, managed, proven, errors, reserved.select("sheet", F.lit(True).alias("reserved")).distinct()):
        rows = rows.join(part, "sheet", "left")
    onboarding = F.coalesce((F.col("mode") == "summary") & F.col("evidence").isNotNull() & F.col("_full") & (F.coalesce("conflicts", F.lit(0)) == 0) & (F.coalesce("selected", F.lit(0)) > 0), F.lit(False))
    return rows.withColumn("onboarding", onboarding).fillna(0, ["matches", "conflicts", "selected", "managed", "errors"]).fillna(False, ["pending_week", "boundary", "reserved"]).drop("_full", "evidence")


def validation_report(checks: DataFrame, minimum_matches: int = 2) -> DataFrame:
    """Per sheet the first cold-start branch that holds, and whether it passes. checks: sheet, mode, matches, conflicts,
    selected, reserved, pending_week, boundary, managed, onboarding, errors."""
    few = F.col("matches") < minimum_matches
    some = F.col("selected") > 0
    branch = (
        F.when(F.col("reserved"), "reserved-row")
        .when((F.col("mode") == "template") & few, "template")
        .when(few & F.col("pending_week"), "pending-week")
        .when(F.col("boundary") & (F.col("managed") == 0), "boundary-baseline")
        .when(few & F.col("onboarding"), "reviewed-onboarding")
        .when(few, "short-history")
        .otherwise("strict")
    )
    rows = checks.withColumn("branch", branch)
    level = (
        F.when(F.col("branch") == "reserved-row", F.when(some, "warning").otherwise("error"))
        .when(F.col("branch") == "template", F.when(some & (F.col("conflicts") == 0), "warning").otherwise("error"))
        .when(F.col("branch") == "short-history", F.when(F.col("mode") == "append", "warning").otherwise("error"))
        .when(F.col("branch") == "strict", "ok")
        .otherwise("warning")
    )
    return rows.withColumn("level", level).withColumn("passes", (F.col("level") != "error") & (F.col("errors") == 0) & (F.col("conflicts") == 0))


def coverage_matrix(sheets: DataFrame, routes: DataFrame, reviews: DataFrame, references: DataFrame) -> DataFrame:
    """Status of every sheet, first that holds: review-required, active, paused, reference, the stored review status,
    unclassified; and whether someone has to act."""
    r = routes.groupBy("sheet").agg(F.bool_or(F.coalesce("benchmark_review_only", F.lit(False))).alias("review"), F.bool_or(~F.coalesce("paused", F.lit(False))).alias("active"))
    rows = sheets.select("sheet").distinct().join(r, "sheet", "left").join(references.select("sheet").distinct().withColumn("ref", F.lit(True)), "sheet", "left").join(reviews.groupBy("sheet").agg(F.min("status").alias("stored")), "sheet", "left")
    status = F.when(F.col("review") & F.col("active"), "review-required").when(F.col("active"), "active").when(~F.col("active"), "paused").when(F.col("ref"), "reference").otherwise(F.coalesce("stored", F.lit("unclassified")))
    return rows.select("sheet", status.alias("status")).withColumn("action_required", F.col("status").isin("review-required", "parser-required", "business-review", "unclassified"))


def operations_summary(routes: DataFrame, reviews: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row: configured, active and paused routes, and reviews that block; with runs (finished, ok, rows) also the last
    run's facts and the time of the last good one."""
    r = routes.agg(F.count("*").alias("configured"), F.count_if(F.coalesce("paused", F.lit(False))).alias("paused"))
    v = reviews.agg(F.count_if(F.col("status").isin("parser-required", "business-review")).alias("blocking"))
    out = r.join(v, how="cross").select("configured", (F.col("configured") - F.col("paused")).alias("active"), "paused", "blocking")  # one row each
    if runs is None:
        return out
    last = runs.agg(F.max_by(F.struct("finished", "ok", "rows"), "finished").alias("l"), F.max(F.when(F.col("ok"), F.col("finished"))).alias("last_good"))
    return out.join(last.select(F.col("l.finished").alias("last_finished"), F.col("l.ok").alias("last_ok"), F.col("l.rows").alias("last_rows"), "last_good"), how="cross")  # one row each


HEAD_SAMPLE, TAIL_SAMPLE, SAMPLE_KEYS = 10, 30, 20


def table_manifest(cells: DataFrame) -> DataFrame:
    """Per sheet: greatest row and column, cells, formulas, order-free digests of values and of formulas, and hashes of its
    first and last rows (sample: at most HEAD_SAMPLE + TAIL_SAMPLE of them)."""
    formula = F.col("kind") == "formula"
    h = F.xxhash64("row", "col", "kind", "value")
    size = cells.groupBy("sheet").agg(F.max("row").alias("_last"))
    summed = lambda keep, name: [F.coalesce(F.bit_xor(F.when(keep, h)), F.lit(0)).alias(f"{name}x"), F.coalesce(F.sum(F.when(keep, h.cast("decimal(38,0)"))), F.lit(0)).alias(f"{name}s")]
    per = cells.groupBy("sheet").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count("*").alias("n_cells"), F.count_if(formula).alias("n_formulas"), *summed(~formula, "v"), *summed(formula, "f"))
    digest = lambda name: F.sha2(F.concat_ws("|", F.col(f"{name}x").cast("string"), F.col(f"{name}s").cast("string")), 256)
    per = per.select("sheet", "max_row", "max_col", "n_cells", "n_formulas", digest("v").alias("values_digest"), digest("f").alias("formulas_digest"))
    edge = cells.join(size, "sheet").where((F.col("row") <= HEAD_SAMPLE) | (F.col("row") > F.col("_last") - TAIL_SAMPLE))
    rows = edge.groupBy("sheet", "row").agg(F.bit_xor(h).alias("hash")).groupBy("sheet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("row", "hash")))).alias("sample"))
    return per.join(rows, "sheet", "left")


def manifest_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """sheet, change (added, removed, changed), differences of rows, columns and cells, values_changed, formulas_changed,
    topology_changed (rows or columns), rows: up to SAMPLE_KEYS of the sampled rows that differ. Equal sheets are left
    out."""
    e, c = expected.alias("e"), current.alias("c")
    both = e.join(c, F.col("e.sheet") == F.col("c.sheet"), "full_outer")
    differs = lambda x: ~F.col(f"e.{x}").eqNullSafe(F.col(f"c.{x}"))
    change = F.when(F.col("e.sheet").isNull(), "added").when(F.col("c.sheet").isNull(), "removed").when(differs("values_digest") | differs("formulas_digest"), "changed")
    delta = lambda x: (F.coalesce(F.col(f"c.{x}"), F.lit(0)) - F.coalesce(F.col(f"e.{x}"), F.lit(0))).alias(f"d_{x}")
    empty = F.create_map().cast("map<int,bigint>")
    old, new = F.coalesce("e.sample", empty), F.coalesce("c.sample", empty)
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    rows = F.slice(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))), 1, SAMPLE_KEYS)
    out = both.select(F.coalesce("e.sheet", "c.sheet").alias("sheet"), change.alias("change"), delta("max_row"), delta("max_col"), delta("n_cells"), differs("values_digest").alias("values_changed"), differs("formulas_digest").alias("formulas_changed"), (differs("max_row") | differs("max_col")).alias("topology_changed"), rows.alias("rows"))
    return out.where(F.col("change").isNotNull())


def concurrency_report(expected: DataFrame, current: DataFrame, expected_fp: DataFrame, current_fp: DataFrame) -> DataFrame:
    """One row: changed sheets, blocked (the base moved: its fingerprint is another), metadata_only (it moved without a
    change of cells). Fingerprints: one row with `fingerprint` each, as fingerprint_of gives them."""
    n = manifest_diff(expected, current).agg(F.count("*").alias("changed_sheets"))
    moved = expected_fp.select(F.col("fingerprint").alias("_e")).join(current_fp.select(F.col("fingerprint").alias("_c")), how="cross")  # one row each
    rows = n.join(moved, how="cross")  # one row each
    return rows.select("changed_sheets", (F.col("_e") != F.col("_c")).alias("blocked"), ((F.col("changed_sheets") == 0) & (F.col("_e") != F.col("_c"))).alias("metadata_only"))
