"""Deduplication, corrections and same-day conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import message_order, row_signature, short_id, source_type


def deduplicate(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per keys, date, code, unit and cumulative (both to 12 digits); the last by `order` wins."""
    same = [*keys, "nav_date", F.coalesce("code", F.lit("")), F.bround("unit", 12), F.bround("cumulative", 12)]
    w = Window.partitionBy(*same).orderBy(F.desc(order))
    return obs.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def day_state(obs: DataFrame) -> DataFrame:
    """Per sheet and date: number of rows, of unit values, of non-null cumulative values, and whether they conflict."""
    sig = row_signature("unit", "cumulative")
    per = obs.groupBy("sheet", "nav_date").agg(F.count("*").alias("n_rows"), F.count_distinct(sig["unit"]).alias("n_units"), F.count_distinct(sig["cumulative"]).alias("n_cums"))
    return per.withColumn("conflict", (F.col("n_units") > 1) | (F.col("n_cums") > 1))


def resolve_same_day(obs: DataFrame) -> DataFrame:
    """One row per sheet and date, one with a cumulative value if there is any. A sheet with a conflict on any date gives
    no rows: it fails as a whole."""
    state = day_state(obs)
    failed = state.where("conflict").select("sheet").distinct()
    rows = obs.groupBy("sheet", "nav_date").agg(F.max_by("unit", F.struct(F.col("cumulative").isNotNull(), "unit")).alias("unit"), F.max("cumulative").alias("cumulative"))
    return rows.join(failed, "sheet", "left_anti")


def date_conflicts(obs: DataFrame) -> DataFrame:
    """sheet, nav_date, candidates, n_values, n_sources, values of each conflicting date; values: distinct (value_id,
    source_id, source_type), by ids, not in clear."""
    value = short_id(F.bround("unit", 10), F.bround("cumulative", 10))
    kind = source_type("source") if "source" in obs.columns else F.lit("parser-output")
    state = day_state(obs).where("conflict").select("sheet", "nav_date")
    rows = obs.join(state, ["sheet", "nav_date"]).select("sheet", "nav_date", "message_id", F.struct(value.alias("value_id"), short_id("message_id").alias("source_id"), kind.alias("source_type")).alias("v"))
    return rows.groupBy("sheet", "nav_date").agg(F.count("*").alias("candidates"), F.count_distinct("v.value_id").alias("n_values"), F.count_distinct("message_id").alias("n_sources"), F.array_sort(F.collect_set("v")).alias("values"))


def correction_winners(obs: DataFrame) -> DataFrame:
    """sheet, nav_date, message_id, replaced (messages) of the corrections that replace a date's other values.

    Needed: the date conflicts; every message has an order, all of one kind (mailbox number, or date where sent_at is
    given and there is no number); each correction message has one value there; the latest
    correction is later than every other message, and there is another one."""
    conflicted = day_state(obs).where("conflict").select("sheet", "nav_date")
    rows = obs.join(conflicted, ["sheet", "nav_date"])
    sig = row_signature("unit", "cumulative")
    sent = F.col("sent_at") if "sent_at" in obs.columns else F.lit(None).cast("timestamp")
    rows = rows.withColumn("_order", message_order(F.col("uid"), sent))
    per = rows.groupBy("sheet", "nav_date", "message_id").agg(F.max("_order.ord").alias("ord"), F.min("_order.kind").alias("kind"), F.max("_order.kind").alias("kind2"), F.bool_or("correction").alias("marked"), F.count_distinct(F.to_json(sig)).alias("n_sig"))
    date = per.groupBy("sheet", "nav_date").agg(
        (F.bool_or(F.col("ord").isNull()) | (F.min("kind") != F.max("kind2"))).alias("unordered"),
        F.bool_or(F.col("marked") & (F.col("n_sig") != 1)).alias("ambiguous"),
        F.max(F.when(F.col("marked"), F.col("ord"))).alias("last_marked"),
        F.max_by("message_id", F.when(F.col("marked"), F.col("ord"))).alias("winner"),
        F.count("*").alias("messages"),
    )
    others = per.join(date, ["sheet", "nav_date"]).where(F.col("message_id") != F.col("winner")).groupBy("sheet", "nav_date").agg(F.max("ord").alias("last_other"))
    ok = ~F.col("unordered") & ~F.col("ambiguous") & F.col("last_marked").isNotNull() & (F.col("last_other") < F.col("last_marked"))
    return date.join(others, ["sheet", "nav_date"]).where(ok).select("sheet", "nav_date", F.col("winner").alias("message_id"), (F.col("messages") - 1).alias("replaced"))


def apply_corrections(obs: DataFrame) -> DataFrame:
    """Observations after corrections: on a corrected date only the winning message's row (one, with a cumulative value
    if there is any) is left; every other date is untouched."""
    won = correction_winners(obs).select("sheet", "nav_date", F.col("message_id").alias("_winner"))
    rows = obs.join(won, ["sheet", "nav_date"], "left")
    w = Window.partitionBy("sheet", "nav_date").orderBy(F.col("cumulative").isNull(), F.col("event_id"))
    kept = rows.where(F.col("_winner").isNull())
    replaced = rows.where(F.col("message_id") == F.col("_winner")).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return kept.unionByName(replaced).drop("_winner")


def bind_subject_code(obs: DataFrame) -> DataFrame:
    """Rows of a message without code take the subject's code if no row of the message has another code, none is mixed
    and each date has one value; else bind_error is true."""
    per = obs.groupBy("message_id").agg(F.count_distinct("code").alias("codes"), F.bool_or(F.col("code").isNull()).alias("blank"), F.max("subject_code").alias("_bind"), F.first("code", ignorenulls=True).alias("_has"))
    dates = obs.groupBy("message_id", "nav_date").agg(F.count_distinct(F.to_json(row_signature("unit", "cumulative"))).alias("v")).groupBy("message_id").agg(F.max("v").alias("values"))
    ok = F.col("_bind").isNotNull() & F.col("blank") & (F.col("codes") == 0) & (F.col("values") == 1)
    flags = per.join(dates, "message_id").select("message_id", F.when(ok, F.col("_bind")).alias("_code"), (F.col("_bind").isNotNull() & F.col("blank") & ~ok).alias("bind_error"))
    return obs.join(flags, "message_id").withColumn("code", F.coalesce("code", "_code")).drop("_code")


def merge_candidates(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Two candidate tables (sender, messages, observations: an array of nav_date, code, unit, cumulative) as one, with
    codes, first_date and last_date: counts add up; of observations of one date and code the current one stays."""
    both = previous.withColumn("_new", F.lit(0)).unionByName(current.withColumn("_new", F.lit(1)))
    counts = both.groupBy("sender").agg(F.sum("messages").alias("messages"))
    rows = both.select("sender", "_new", F.inline("observations"))
    latest = F.max_by(F.struct("nav_date", "code", "unit", "cumulative"), F.struct("_new", "unit", "cumulative")).alias("o")
    kept = rows.groupBy("sender", "nav_date", F.coalesce("code", F.lit("")).alias("_code")).agg(latest)
    per = kept.groupBy("sender").agg(
        F.array_sort(F.collect_set("o.code")).alias("codes"),
        F.min("nav_date").alias("first_date"),
        F.max("nav_date").alias("last_date"),
        F.array_sort(F.collect_list("o")).alias("observations"),
    )
    return counts.join(per, "sender", "left")
