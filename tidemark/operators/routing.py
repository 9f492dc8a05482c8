"""Routing of observations to sheets, and matching of senders and codes with routes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import normalize_code, row_signature
from tidemark.operators.filters import active_routes


def accepted_codes(routes: DataFrame) -> DataFrame:
    """One row per route and accepted code (its own and its aliases)."""
    codes = F.array_distinct(F.concat(F.array("code"), F.coalesce("code_aliases", F.array().cast("array<string>"))))
    return routes.withColumn("accepted", F.explode(F.filter(codes, lambda c: c.isNotNull())))


#: Terms of subject conditions up to which they are sent to all tasks as one automaton per sender; beyond, they are joined.
MOST_TERMS = 200_000


def subject_terms(routes: DataFrame) -> DataFrame:
    """sender, term: what the routes' subject conditions ask for or ban, in lower case."""
    held = F.concat(F.array("_contains"), F.coalesce("_excludes", F.array().cast("array<string>")))
    terms = routes.select("sender", F.explode(F.transform(held, lambda t: F.lower(t))).alias("term"))
    return terms.where("term <> ''").distinct()


def with_terms(kinds: DataFrame, terms: DataFrame) -> DataFrame:
    """kinds (sender, subject) with terms: those of the sender's that the subject holds. Each subject is read once, by an
    automaton of all terms of its sender, whatever the number of routes."""
    low = F.lower("subject").alias("low")
    some = terms.limit(MOST_TERMS + 1).collect()
    if len(some) > MOST_TERMS:  # the other way: pairs of a sender's subjects and terms
        held = kinds.join(terms, "sender").where(F.lower("subject").contains(F.col("term"))).groupBy("sender", "subject").agg(F.collect_set("term").alias("terms"))
        return kinds.join(held, ["sender", "subject"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    of: dict[str, list[str]] = {}
    for r in some:
        of.setdefault(r["sender"], []).append(r["term"])
    if not of:
        return kinds.withColumn("terms", F.array().cast("array<string>"))
    shared = kinds.sparkSession.sparkContext.broadcast(of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        made: dict[str, ahocorasick.Automaton] = {}
        for batch in batches:
            found = []
            for sender, subject in zip(batch.column("sender").to_pylist(), batch.column("low").to_pylist(), strict=True):
                own = made.get(sender)
                if own is None:
                    own = made[sender] = ahocorasick.Automaton()
                    for t in shared.value.get(sender, ()):
                        own.add_word(t, t)
                    own.make_automaton()
                found.append(sorted({t for _, t in own.iter(subject)}) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column("sender"), batch.column("subject"), pa.array(found, pa.list_(pa.string()))], ["sender", "subject", "terms"])

    return kinds.select("sender", "subject", low).mapInArrow(read, "sender string, subject string, terms array<string>")


def applicable(messages: DataFrame, routes: DataFrame) -> DataFrame:
    """sender, subject and the routes that apply to such messages: those of the sender whose subject conditions hold
    (subject_contains, subject_excludes, where routes have them). One row per distinct sender and subject and route, so
    the work doesn't grow with the messages of one kind; routes that ask for a term are met by that term."""
    subject = F.coalesce(F.col("subject"), F.lit("")) if "subject" in messages.columns else F.lit("")
    kinds = messages.select("sender", subject.alias("subject")).distinct()
    column = lambda c, kind: (F.col(c) if c in routes.columns else F.lit(None)).cast(kind)
    rules = routes.withColumns({"_contains": column("subject_contains", "string"), "_excludes": column("subject_excludes", "array<string>")})
    if not {"subject_contains", "subject_excludes"} & set(routes.columns):
        return kinds.join(rules, "sender").drop("_contains", "_excludes")
    read = with_terms(kinds, subject_terms(rules))
    asked = F.coalesce(F.lower("_contains"), F.lit(""))
    open_ = read.join(rules.where(asked == ""), "sender")
    told = read.withColumn("_term", F.explode("terms")).join(rules.where(asked != "").withColumn("_term", asked), ["sender", "_term"]).drop("_term")
    both = open_.unionByName(told)
    banned = F.transform(F.coalesce("_excludes", F.array().cast("array<string>")), lambda t: F.lower(t))
    return both.where(~F.coalesce(F.arrays_overlap("terms", F.filter(banned, lambda t: t.isNotNull())), F.lit(False))).drop("_contains", "_excludes", "terms")


def subject_bindings(obs: DataFrame, active: DataFrame) -> DataFrame:
    """sender, subject, message_id, bound, bind_error of messages with rows that have no code, where a route that applies
    names its subject_product_code. bound: the code of that route, if it alone applies at the dates of those rows, no
    row of the message has a code, and each date has one value; else bind_error. Rows before every route's series_start
    ask for nothing."""
    first_day = F.lit("0001-01-01").cast("date")
    facts = active.groupBy("sender", "subject").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("series_start", first_day).alias("start"), "sheet", normalize_code("subject_product_code").alias("code")))), 1, 2).alias("first"),
        F.count("subject_product_code").alias("_naming"),
    )
    facts = facts.where("_naming > 0").select("sender", "subject", F.get("first", F.lit(0))["start"].alias("_start"), F.get("first", F.lit(0))["code"].alias("_names"), F.get("first", F.lit(1))["start"].alias("_second"))
    blank = F.col("code").isNull()
    rows = obs.join(facts, ["sender", "subject"])
    value = row_signature("unit", "cumulative" if "cumulative" in obs.columns else F.lit(None).cast("double"))
    per_day = rows.groupBy("sender", "subject", "message_id", "nav_date").agg(
        F.bool_or(blank).alias("blank"), F.bool_or(~blank).alias("coded"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.first("_start").alias("_start"), F.first("_names").alias("_names"), F.first("_second").alias("_second"),
    )
    asked = F.col("blank") & (F.col("nav_date") >= F.col("_start"))
    per = per_day.groupBy("sender", "subject", "message_id").agg(
        F.max(F.when(asked, F.col("nav_date"))).alias("last"), F.bool_or("coded").alias("coded"), F.bool_or(F.col("lo") != F.col("hi")).alias("several"),
        F.first("_names").alias("_names"), F.first("_second").alias("_second"),
    ).where("last is not null")
    ok = F.col("_names").isNotNull() & F.coalesce(F.col("last") < F.col("_second"), F.lit(True)) & ~F.col("coded") & ~F.col("several")
    return per.select("sender", "subject", "message_id", F.when(ok, F.col("_names")).alias("bound"), (~ok).alias("bind_error"))


def route_observations(obs: DataFrame, routes: DataFrame) -> DataFrame:
    """Every observation with outcome and reason: routed, pre_managed (before series_start), unconfigured (a code that no
    applicable route accepts), or error (`no-code`, `no-route`, `several-routes`). Routed rows carry sheet and the
    route's primary code. Where one route alone applies to a message, a row without code goes to it if it allows that,
    and any row if the route has no code. Where routes name a subject_product_code, messages without codes take it
    (subject_bindings); a message that can't is an error as a whole (`subject-binding`)."""
    if "subject" not in obs.columns:
        return route_observations(obs.withColumn("subject", F.lit("")), routes).drop("subject")
    active = applicable(obs, active_routes(routes))
    if "subject_product_code" in routes.columns:
        return route_bound(obs, routes, active)
    return route_by_code(obs, routes, active)


def route_bound(obs: DataFrame, routes: DataFrame, active: DataFrame) -> DataFrame:
    keyed = obs.withColumn("_said", F.col("subject")).withColumn("subject", F.coalesce("subject", F.lit("")))
    rows = keyed.join(subject_bindings(keyed, active), ["sender", "subject", "message_id"], "left").withColumn("subject", F.col("_said")).drop("_said")
    rows = rows.withColumn("code", F.coalesce("bound", "code"))
    if "source" in obs.columns:
        rows = rows.withColumn("source", F.when(F.col("bound").isNotNull(), F.concat("source", F.lit(":subject-code"))).otherwise(F.col("source")))
    out = route_by_code(rows, routes, active)
    bad = F.coalesce("bind_error", F.lit(False))
    out = out.withColumns({"sheet": F.when(~bad, F.col("sheet")), "outcome": F.when(bad, "error").otherwise(F.col("outcome")), "reason": F.when(bad, "subject-binding").otherwise(F.col("reason"))})
    return out.drop("bound", "bind_error")


def route_by_code(obs: DataFrame, routes: DataFrame, active: DataFrame) -> DataFrame:
    coded = F.col("code").isNotNull() | (F.size(F.coalesce("code_aliases", F.array().cast("array<string>"))) > 0)
    single = active.groupBy("sender", "subject").agg(F.count("*").alias("_routes"), F.first("sheet").alias("_only"), F.bool_and(F.coalesce("allow_sender_only", F.lit(False))).alias("_open"), F.bool_or(coded).alias("_coded"))
    match = accepted_codes(active).select("sender", "subject", F.col("accepted").alias("code"), F.col("sheet").alias("_sheet"))
    hits = match.groupBy("sender", "subject", "code").agg(F.count("*").alias("_hits"), F.first("_sheet").alias("_sheet"))
    keyed = obs.withColumn("_said", F.col("subject")).withColumn("subject", F.coalesce("subject", F.lit("")))
    rows = keyed.join(hits, ["sender", "subject", "code"], "left").join(single, ["sender", "subject"], "left")
    alone = F.coalesce(F.col("_routes") == 1, F.lit(False))
    bare = alone & ((F.col("code").isNull() & F.col("_open")) | ~F.col("_coded"))
    rows = rows.withColumn("sheet", F.when(F.col("_hits") == 1, F.col("_sheet")).when(bare, F.col("_only")))
    facts = active_routes(routes).select(F.col("sheet"), F.col("series_start").alias("_start"), F.col("code").alias("_primary"))
    rows = rows.join(facts, "sheet", "left")
    found = F.col("sheet").isNotNull()
    outcome = F.when(found, F.when(F.col("nav_date") < F.col("_start"), "pre_managed").otherwise("routed")).when(F.col("code").isNotNull() & F.col("_hits").isNull(), "unconfigured").otherwise("error")
    reason = F.when(found, None).when(F.col("_hits") > 1, "several-routes").when(F.col("_routes").isNull(), "no-route").when(F.col("code").isNull(), F.when(F.col("_routes") > 1, "several-routes").otherwise("no-code"))
    out = rows.withColumns({"outcome": outcome, "reason": F.when(outcome == "error", reason), "code": F.coalesce("_primary", "code"), "subject": F.col("_said")})
    return out.select(*obs.columns, *[c for c in ("sheet", "outcome", "reason") if c not in obs.columns])


def unconfigured_rows(obs: DataFrame, routes: DataFrame) -> DataFrame:
    """Per sender: rows and messages with a code that no active route accepts."""
    match = accepted_codes(active_routes(routes)).select("sender", F.col("accepted").alias("code"))
    return obs.where(F.col("code").isNotNull()).join(match, ["sender", "code"], "left_anti").groupBy("sender").agg(F.count("*").alias("n_rows"), F.count_distinct("message_id").alias("n_messages"))


def route_overlaps(messages: DataFrame, routes: DataFrame, ids: int = 5, salts: int = 64, spread: int = 240) -> DataFrame:
    """Pairs of routes that apply to one message: route_a, route_b, reason (`subject` where one of them has a subject
    condition, else `sender`), messages, first_ids.

    Messages are counted per kind (sender and subject) first, with their first ids per salt before these meet. Sheets that
    apply to the same kinds are one class; numbers are found per pair of classes. There are as many rows as pairs of
    sheets, so these are made last, `spread` tasks at a time, and are not shuffled."""
    subject = F.coalesce(F.col("subject"), F.lit("")) if "subject" in messages.columns else F.lit("")
    condition = F.lit(False)
    for c in ("subject_contains", "subject_excludes"):
        if c in routes.columns:
            condition = condition | F.col(c).isNotNull()
    said = messages.select("message_id", "sender", subject.alias("subject"), F.pmod(F.xxhash64("message_id"), F.lit(salts)).alias("_salt")).distinct()
    first = Window.partitionBy("sender", "subject", "_salt").orderBy("message_id")
    some = F.collect_list(F.when(F.col("_n") <= ids, F.col("message_id")))
    least = lambda lists: F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, ids)
    kinds = said.withColumn("_n", F.row_number().over(first)).groupBy("sender", "subject", "_salt").agg(F.count("*").alias("n"), some.alias("ids"))
    kinds = kinds.groupBy("sender", "subject").agg(F.sum("n").alias("n"), least("ids").alias("ids"))
    apply = applicable(messages, routes).groupBy("sheet", "sender", "subject").agg(F.bool_or(condition).alias("limited"))
    kind = F.struct("sender", "subject", "limited")
    classed = apply.groupBy("sheet").agg(F.array_sort(F.collect_list(kind)).alias("kinds")).withColumn("class", F.sha2(F.to_json("kinds"), 256))
    sheets = classed.select("sheet", "class")
    held = classed.groupBy("class").agg(F.first("kinds").alias("kinds")).select("class", F.inline("kinds"))
    side = lambda x: held.select("sender", "subject", F.col("class").alias(f"class_{x}"), F.col("limited").alias(f"limited_{x}"))
    reason = F.when(F.col("limited_a") | F.col("limited_b"), "subject").otherwise("sender")
    per = side("a").join(side("b"), ["sender", "subject"]).join(kinds, ["sender", "subject"]).groupBy("class_a", "class_b", reason.alias("reason")).agg(F.sum("n").alias("messages"), least("ids").alias("first_ids"))
    a = sheets.select(F.col("class").alias("class_a"), F.col("sheet").alias("route_a")).join(per, "class_a")
    a = a.withColumn("_part", F.pmod(F.xxhash64("route_a"), F.lit(salts))).repartition(spread, "class_b", "_part")
    b = sheets.select(F.col("class").alias("class_b"), F.col("sheet").alias("route_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("_part")).repartition(spread, "class_b", "_part")
    return a.join(b, ["class_b", "_part"]).where("route_a < route_b").select("route_a", "route_b", "reason", "messages", "first_ids")


def row_overlaps(obs: DataFrame, routes: DataFrame, ids: int = 5) -> DataFrame:
    """Pairs of routes that both accept a row's code at its date: route_a, route_b, rows, messages, first_ids."""
    if "subject" not in obs.columns:
        obs = obs.withColumn("subject", F.lit(""))
    match = accepted_codes(applicable(obs, active_routes(routes))).select("sender", "subject", F.col("accepted").alias("code"), "sheet", "series_start")
    sets = match.groupBy("sender", "subject", "code").agg(F.collect_set(F.struct("sheet", "series_start")).alias("by")).where(F.size("by") > 1)
    rows = obs.select("sender", F.coalesce("subject", F.lit("")).alias("subject"), "code", "nav_date", "message_id").join(sets, ["sender", "subject", "code"])
    holds = F.filter("by", lambda r: F.coalesce(r["series_start"] <= F.col("nav_date"), F.lit(True)))
    rows = rows.select("message_id", F.array_sort(F.transform(holds, lambda r: r["sheet"])).alias("sheets")).where(F.size("sheets") > 1)
    # rows are counted per set of routes and message, messages per set; pairs are made of the distinct sets
    per = rows.groupBy("sheets", "message_id").agg(F.count("*").alias("n"))
    first = Window.partitionBy("sheets", F.pmod(F.xxhash64("message_id"), F.lit(64))).orderBy("message_id")
    some = F.collect_list(F.when(F.col("_i") <= ids, F.col("message_id")))
    per = per.withColumn("_i", F.row_number().over(first)).groupBy("sheets").agg(F.sum("n").alias("rows"), F.count("*").alias("messages"), F.slice(F.array_sort(some), 1, ids).alias("ids"))
    a = per.select("*", F.posexplode("sheets").alias("_at", "route_a"))
    pairs = a.select("route_a", "rows", "messages", "ids", F.explode(F.slice("sheets", F.col("_at") + 2, F.size("sheets"))).alias("route_b"))
    return pairs.groupBy("route_a", "route_b").agg(F.sum("rows").alias("rows"), F.sum("messages").alias("messages"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("first_ids"))


def match_candidates(cands: DataFrame, routes: DataFrame) -> DataFrame:
    """status of every (sender, code): matched, new (no route accepts it) or not-seen (a route without candidate)."""
    accepted = accepted_codes(routes).select("sender", F.col("accepted").alias("code"), "sheet")
    c = cands.select("sender", "code").distinct()
    matched = c.join(accepted, ["sender", "code"]).select("sender", "code", F.lit("matched").alias("status"))
    new = c.join(accepted, ["sender", "code"], "left_anti").select("sender", "code", F.lit("new").alias("status"))
    seen = c.join(accepted, ["sender", "code"]).select("sheet").distinct()
    unseen = routes.join(seen, "sheet", "left_anti").select("sender", "code", F.lit("not-seen").alias("status"))
    return matched.union(new).union(unseen)


#: Letters that a share class adds to a code, at most.
SUFFIX = 12


def alias_pending(cands: DataFrame, routes: DataFrame) -> DataFrame:
    """Candidates whose code begins with a route's code of the same sender, or the other way round, with 1 to 12 letters,
    digits, _ or - more, if there is exactly one such route. A suggestion; nothing is routed by it.

    The longer code's prefixes, at most SUFFIX of them, are looked up among the other side's codes, so codes meet only
    where one begins with the other."""
    c = cands.select("sender", "code").distinct().join(accepted_codes(routes).select("sender", F.col("accepted").alias("code")), ["sender", "code"], "left_anti")
    r = routes.where(F.col("code").isNotNull()).select("sender", F.col("code").alias("route_code"), "sheet")

    def prefixes(code: str):
        """The code without its last 1 to SUFFIX characters, where these are such characters."""
        size = F.length(code)
        cut = F.transform(F.sequence(F.lit(1), F.lit(SUFFIX)), lambda n: F.when((n < size) & F.substr(code, size - n + 1).rlike("^[A-Z0-9_-]+$"), F.substr(code, F.lit(1), size - n)))
        return F.explode(F.filter(cut, lambda x: x.isNotNull()))

    longer = c.withColumn("route_code", prefixes("code")).join(r, ["sender", "route_code"])
    shorter = r.withColumn("code", prefixes("route_code")).join(c, ["sender", "code"])
    near = longer.select("sender", "code", "route_code", "sheet").union(shorter.select("sender", "code", "route_code", "sheet"))
    w = Window.partitionBy("sender", "code")
    return near.withColumn("_n", F.count("*").over(w)).where("_n = 1").select("sender", "code", "route_code", "sheet")


def select_code(cands: DataFrame, hist: DataFrame) -> DataFrame:
    """Per sheet: the one code that candidates and history share; several or none: null, with the number found."""
    both = cands.select("sheet", "code").distinct().join(hist.select("sheet", "code").distinct(), ["sheet", "code"])
    return cands.select("sheet").distinct().join(both.groupBy("sheet").agg(F.count("*").alias("n"), F.min("code").alias("c")), "sheet", "left").select(
        "sheet", F.when(F.col("n") == 1, F.col("c")).alias("code"), F.coalesce("n", F.lit(0)).cast("long").alias("shared")
    )
