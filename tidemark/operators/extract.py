"""Extraction of observations from notices: delimited text, labelled lines, HTML tables, fixed layouts.

A notice is taken apart once, in one Arrow pass over the messages: Spark deals the rows, a task reads each message's
tables, binds their headers and gives typed observations. Nothing is shuffled, and nothing is parsed twice.
"""

from __future__ import annotations

import csv
import datetime as dt
import html
import io
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import HEADER_WORDS, parse_date, parse_number

HEADER_ROWS = 50
OBSERVATION = "message_id string, nav_date date, unit double, cumulative double, code string, source string"
#: Attachments that are read as delimited text.
DELIMITED_SUFFIXES = ("csv", "txt")
#: Most characters of a text, and rows, columns and cells of a table; beyond them a message is refused.
MOST_CHARS, MOST_ROWS, MOST_COLUMNS, MOST_CELLS = 2_000_000, 20_000, 200, 2_000_000


class Row(NamedTuple):
    nav_date: dt.date
    unit: float
    cumulative: float | None
    code: str | None
    source: str


class Refused(ValueError):
    """A part of a message that can't be read without guessing. reason is what a report says."""

    def __init__(self, what: str, reason: str = "invalid-or-unsupported-content"):
        super().__init__(what)
        self.reason = reason


def too_large(what: str) -> Refused:
    return Refused(f"too large: {what}", "resource-limit")


# The rules of functions.scalars for single values; a test holds both against each other.
NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)", re.ASCII)
SERIAL = re.compile(r"\d{5}(\.\d+)?", re.ASCII)
DAY = re.compile(r"(?<!\d)(20\d{2})-?(\d{1,2})-?(\d{1,2})(?!\d)", re.ASCII)
SEPARATORS = str.maketrans({"年": "-", "月": "-", "/": "-", ".": "-", "日": None})
DROPPED = re.compile(r"[\s_:/：()（）\[\]-]", re.ASCII)
WIDE = re.compile(r"\s{2,}")
FIRST_SERIAL_DAY = dt.date(1899, 12, 30)


def number(cell: str | None) -> float | None:
    plain = cell or ""
    if "," in plain or "\uff0c" in plain:
        plain = plain.replace(",", "").replace("\uff0c", "")
    plain = plain.strip()
    value = float(plain) if NUMBER.fullmatch(plain) else 0.0
    return value if 0 < value < 1_000_000 else None


@lru_cache(20_000)
def day(cell: str | None, pivot: int = 80) -> dt.date | None:
    said = (cell or "").strip()
    if SERIAL.fullmatch(said) and 20000.5 <= float(said) <= 99999.5:
        return FIRST_SERIAL_DAY + dt.timedelta(days=int(float(said)))
    if found := DAY.search(said.translate(SEPARATORS)):
        parts = [*map(int, found.groups())]
    else:
        digits = "".join(c for c in said if "0" <= c <= "9")
        if len(digits) != 6:
            return None
        parts = [int(digits[i : i + 2]) for i in (0, 2, 4)]
        parts[0] += 1900 if parts[0] >= pivot else 2000
    try:
        return dt.date(*parts)
    except ValueError:
        return None


@lru_cache(20_000)
def code(cell: str | None) -> str | None:
    return re.sub("[^A-Za-z0-9]", "", cell or "").upper() or None


@lru_cache(20_000)
def role(cell: str | None) -> str | None:
    """Role of a header cell, as classify_header() gives it."""
    name = DROPPED.sub("", cell or "").lower()
    return next((kind for kind, words in HEADER_WORDS.items() if any(w in name for w in words)), None)


def bound(table: list[list[str]], source: str) -> list[Row]:
    """Observations of a table. Its header is the first of the first rows with date and unit columns below which a row has
    a date and a value; one with several date columns is refused, as the table then is ambiguous."""
    if len(table) > MOST_ROWS or max(map(len, table), default=0) > MOST_COLUMNS or sum(map(len, table)) > MOST_CELLS:
        raise too_large("table")
    for at, cells in enumerate(table[:HEADER_ROWS]):
        roles = [role(c) for c in cells]
        if "date" not in roles or "unit" not in roles:
            continue
        if roles.count("date") > 1:
            raise Refused("several date columns")
        d, u, c, k = (roles.index(x) if x in roles else sys.maxsize for x in ("date", "unit", "cumulative", "code"))
        rows = []
        for line in table[at + 1 :]:
            if max(d, u) < len(line) and (when := day(line[d])) and (value := number(line[u])) is not None:
                rows.append(Row(when, value, number(line[c]) if c < len(line) else None, code(line[k]) if k < len(line) else None, source))
        if rows:
            return rows
    return []


def plain_lines(text: str) -> list[str]:
    if len(text) > MOST_CHARS:
        raise too_large("text")
    return html.unescape(text).replace("\u00a0", " ").splitlines()


def text_tables(lines: list[str]) -> Iterator[list[list[str]]]:
    """The tables of a text, one per delimiter that it holds: the lines that hold the delimiter, cut by it."""
    said = "\0".join(lines)
    for d in "|\t,;":
        if d in said:
            yield [[*map(str.strip, line.split(d))] for line in lines if d in line]
    if WIDE.search(said):
        wide = (WIDE.split(line.strip()) for line in lines)
        yield [cells for cells in wide if len(cells) > 1]


LABEL = re.compile(r"\s*([^:：]{1,30})\s*[:：]\s*(.*\S)\s*")


def labelled(lines: list[str], subject: str, source: str) -> list[Row]:
    """One observation, at most, from `label: value` lines, with the subject for a missing date; a role that occurs twice
    is refused."""
    said: dict[str, str] = {}
    for line in lines:
        found = LABEL.fullmatch(line)
        kind = role(found[1]) if found else None
        if kind in said:
            raise Refused(f"{kind} is named twice")
        if kind:
            said[kind] = found[2]
    when, value = day(said.get("date") or subject), number(said.get("unit"))
    return [Row(when, value, number(said.get("cumulative")), code(said.get("code")), source)] if when and value is not None else []


def of_text(text: str, subject: str, source: str) -> list[Row]:
    """Observations of a text's tables, or of its labelled lines where no table gives one."""
    lines = plain_lines(text)
    return [row for table in text_tables(lines) for row in bound(table, source)] or labelled(lines, subject, source)


class Tables(HTMLParser):
    """Rows of the tables of a page. A cell that spans rows is repeated below; one that spans columns gives empty cells,
    so that a grouped heading isn't taken for a column's own. Bad or overlapping spans raise ValueError. said has the
    page's text besides, with line breaks where blocks begin and without scripts and styles."""

    BLOCKS, SILENT = ("br", "div", "li", "p", "td", "th", "tr"), ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[dict] = []
        self.said: list[str] = []
        self.silent = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BLOCKS:
            self.said.append("\n")
        self.silent = tag in self.SILENT
        if tag == "table":
            self.open.append({"rows": [], "down": {}, "row": None, "cell": None})
        elif self.open and tag == "tr":
            self.end_row()
            self.open[-1]["row"] = {}
        elif self.open and tag in ("td", "th"):
            self.end_cell()
            t = self.open[-1]
            if t["row"] is None:
                t["row"] = {}
            a = dict(attrs)
            t["cell"] = {"text": [], "rows": self.span(a.get("rowspan")), "columns": self.span(a.get("colspan"))}

    @staticmethod
    def span(value: str | None) -> int:
        n = int(value) if value is not None else 1
        if not 1 <= n <= 1000:
            raise ValueError("bad span")
        return n

    def handle_endtag(self, tag: str) -> None:
        self.silent = False
        if not self.open:
            return
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table":
            self.end_row()
            self.tables.append(self.open.pop()["rows"])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.said.append(data)
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"]["text"].append(data)

    def end_cell(self) -> None:
        t = self.open[-1]
        cell, t["cell"] = t["cell"], None
        if not cell:
            return
        at = 0
        while at in t["row"] or at in t["down"]:
            at += 1
        said = " ".join("".join(cell["text"]).split()) if cell["columns"] == 1 else ""
        for c in range(at, at + cell["columns"]):
            if c in t["down"] or c in t["row"]:
                raise ValueError("overlapping spans")
            t["row"][c] = said
            if cell["rows"] > 1:
                t.setdefault("next", {})[c] = [cell["rows"] - 1, said]

    def end_row(self) -> None:
        self.end_cell()
        t = self.open[-1]
        if t["row"] is None:
            return
        row = {**{c: said for c, (_, said) in t["down"].items()}, **t["row"]}
        t["rows"].append([row.get(c, "") for c in range(max(row, default=-1) + 1)])
        t["down"] = {c: [n - 1, said] for c, (n, said) in t["down"].items() if n > 1} | t.pop("next", {})
        t["row"] = None


def parsed_page(page: str) -> tuple[list[list[list[str]]], str]:
    """The tables of a page and its text."""
    t = Tables()
    try:
        t.feed(page)
        t.close()
        while t.open:
            t.handle_endtag("table")
    except ValueError as e:
        raise Refused(str(e)) from e
    return t.tables, "".join(t.said)


def of_page(page: str, subject: str) -> list[Row]:
    """Observations of a page's tables and of its text."""
    tables, said = parsed_page(page)
    return [row for table in tables for row in bound(table, "html")] + of_text(said, subject, "html")


def decoded(payload: bytes) -> str | None:
    """UTF-8 with or without its mark, else GB18030, else UTF-16, else null."""
    for codec in ("utf-8-sig", "gb18030", "utf-16"):
        try:
            return payload.decode(codec)
        except UnicodeDecodeError:
            continue
    return None


#: The delimiters that csv.Sniffer prefers, best first.
USUAL = ",\t; :"


def even_characters(lines: list[str]) -> dict[str, tuple[int, int]]:
    """Characters that stand equally often in all lines, or else in as many more lines than not as possible, nine of ten
    at least: how often, and in how many more lines."""
    first = {c: lines[0].count(c) for c in set(lines[0]) if c < "\x7f"}
    if found := {c: (k, len(lines)) for c, k in first.items() if all(line.count(c) == k for line in lines)}:
        return found
    most = {}
    for c in {c for c in set().union(*lines) if c < "\x7f"}:
        (k, n), *_ = Counter(line.count(c) for line in lines).most_common(1)
        if k > 0:
            most[c] = (k, 2 * n - len(lines))
    share = 1.0
    while not found and share >= 0.9:
        found = {c: v for c, v in most.items() if v[1] / len(lines) >= share}
        share -= 0.01
    return found


def even_dialect(sample: str) -> dict | None:
    """The dialect that csv.Sniffer gives for a text without quotes, in a tenth of its time: it counts all of ASCII in all
    lines, here only characters that occur are counted, and only until there are candidates, which later lines can't change."""
    lines = [line for line in sample.split("\n") if line]
    for n in range(10, len(lines) + 10, 10):
        if found := even_characters(lines[:n]):
            d = next((c for c in USUAL if c in found), None) or max((v, c) for c, v in found.items())[1]
            return {"delimiter": d, "doublequote": False, "skipinitialspace": lines[0].count(d) == lines[0].count(d + " ")}
    return None


def delimited_table(text: str) -> list[list[str]]:
    """Rows of cells of delimited text, its dialect guessed from its beginning (comma, if nothing is to be seen).
    Delimiters and line breaks inside quotes part nothing. Rows without cells are left out."""
    csv.field_size_limit(sys.maxsize)
    sample = text[:4096]
    if "'" in sample or '"' in sample:
        try:
            dialect = {"dialect": csv.Sniffer().sniff(sample)}
        except csv.Error:
            dialect = {}
    else:
        dialect = even_dialect(sample) or {}
    rows = ([*map(str.strip, line)] for line in csv.reader(io.StringIO(text, newline=""), **dialect))
    return [cells for cells in rows if any(cells)]


def of_file(payload: bytes) -> list[Row]:
    text = decoded(payload)
    if text is None:
        raise Refused("no encoding fits")
    try:
        return bound(delimited_table(text), "csv")
    except csv.Error as e:
        raise Refused(str(e)) from e


def distinct(rows: Iterable[Row]) -> list[Row]:
    """Rows by date, code and values of 12 decimals; of equal ones the last stays."""
    rows = [*rows]
    if len({(r.nav_date, r.code) for r in rows}) == len(rows):
        return rows
    exact = lambda x: None if x is None else round(x, 12)
    return [*{(r.nav_date, r.code, exact(r.unit), exact(r.cumulative)): r for r in rows}.values()]


class Read(NamedTuple):
    """What reading a message gave: reason is null unless it failed; files tells of attachments (suffix, status, reason)."""

    rows: list[Row]
    reason: str | None = None
    files: list[tuple[str, str, str]] = []  # noqa: RUF012


def parts(body) -> list[str]:
    return [] if body is None else [body] if isinstance(body, str) else [x for x in body if x is not None]


def read_message(message: dict) -> Read:
    """The built-in extractor: text, HTML tables and text, delimited attachments. One part that fails fails the message."""
    rows: list[Row] = []
    files: list[tuple[str, str, str]] = []
    failed = None
    try:
        subject = message.get("subject") or ""
        for text in parts(message.get("plain")):
            rows += of_text(text, subject, "text")
        for page in parts(message.get("html")):
            rows += of_page(page, subject)
    except Refused as e:
        failed = e.reason
    for file in message.get("attachments") or []:
        suffix = (file["suffix"] or "").lower().removeprefix(".")
        if suffix not in DELIMITED_SUFFIXES or not file["payload"]:
            continue
        try:
            own = of_file(file["payload"])
            rows += own
            if not own:
                files.append((suffix, "no-nav-records", "no-structured-nav-records"))
        except Refused as e:
            files.append((suffix, "failed", e.reason))
            failed = failed or e.reason
    return Read([] if failed else distinct(rows), failed, files)


Extractor = Callable[[dict], Iterable]
EXTRACTORS: dict[str, Extractor] = {}
READ = "rows array<struct<nav_date: date, unit: double, cumulative: double, code: string, source: string>>, reason string, files array<struct<suffix: string, status: string, reason: string>>"
ROW_TYPES = (("nav_date", pa.date32()), ("unit", pa.float64()), ("cumulative", pa.float64()), ("code", pa.string()), ("source", pa.string()))
FILE_TYPES = (("suffix", pa.string()), ("status", pa.string()), ("reason", pa.string()))


def nested(lists: list[list[tuple]], types: tuple) -> pa.Array:
    """An array of lists of structs."""
    flat = [*zip(*(x for some in lists for x in some), strict=True)] or [()] * len(types)
    columns = [pa.array(x, t) for x, (_, t) in zip(flat, types, strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in types]))


def read_rows(df: DataFrame, key: str, columns: list[str], reader: Callable[[dict], Read]) -> DataFrame:
    """key, rows, reason, files: what reader gives for each row of df, in one pass over the columns that it needs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                got = [reader(m) for m in some.select(columns).to_pylist()]
                told = [nested([r.rows for r in got], ROW_TYPES), pa.array([r.reason for r in got], pa.string()), nested([r.files for r in got], FILE_TYPES)]
                yield pa.RecordBatch.from_arrays([some.column(key), *told], [key, "rows", "reason", "files"])

    chosen = df.select(*dict.fromkeys([key, *columns]))
    return chosen.mapInArrow(read, f"{key} {chosen.schema[key].dataType.simpleString()}, {READ}")


def observed(read: DataFrame, key: str) -> DataFrame:
    return read.where("reason is null").select(key, F.inline("rows")).select(key, "nav_date", "unit", "cumulative", "code", "source")


def attempted(read: Callable[[dict], list[Row]]) -> Callable[[dict], Read]:
    def reader(message: dict) -> Read:
        try:
            return Read(distinct(read(message)))
        except Refused as e:
            return Read([], e.reason)

    return reader


def extract_delimited(df: DataFrame, key: str, text: str) -> DataFrame:
    """Observations of text tables; a text with an ambiguous table gives none."""
    read = attempted(lambda m: [row for table in text_tables(plain_lines(m[text] or "")) for row in bound(table, "text")])
    return observed(read_rows(df, key, [text], read), key)


def extract_labelled(df: DataFrame, key: str, text: str, subject: str) -> DataFrame:
    """One observation per message from `label: value` lines. A role that occurs twice rejects the message; a missing date
    is taken from the subject."""
    read = attempted(lambda m: labelled(plain_lines(m[text] or ""), m[subject] or "", "text"))
    return observed(read_rows(df, key, [text, subject], read), key)


def extract_html_tables(df: DataFrame, key: str, page: str) -> DataFrame:
    """Observations of the pages' tables; pages with bad spans or an ambiguous table give none."""
    read = attempted(lambda m: [row for table in parsed_page(m[page] or "")[0] for row in bound(table, "html")])
    return observed(read_rows(df, key, [page], read), key)


#: Bytes of payloads that are taken apart at a time; what is made of them takes many times as much.
AT_A_TIME = 1 << 20


def by_bytes(batch: pa.RecordBatch, column: int, most: int = AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `most` bytes of a column, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def read_delimited_payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, text, row (from 1), cells of attachments; a payload that no encoding fits, or without rows, has one row with
    null cells."""

    def table(text: str | None) -> list[list[str]] | None:
        try:
            return None if text is None else delimited_table(text)
        except csv.Error:
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part for batch in batches for part in by_bytes(batch, 1)):
            texts = [None if raw is None else decoded(raw) for raw in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string()), pa.array(map(table, texts), pa.list_(pa.list_(pa.string())))], [key, "text", "rows"])

    chosen = df.select(key, F.col(payload).alias("_payload"))
    rows = chosen.mapInArrow(read, f"{key} {chosen.schema[key].dataType.simpleString()}, text string, rows array<array<string>>")
    return rows.select(key, "text", F.posexplode_outer("rows").alias("row", "cells")).withColumn("row", F.col("row") + 1)


def unescape(c: Column) -> Column:
    """The entities that text tables use, and the no-break space."""
    out = c
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("\u00a0", " ")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_to_text(c) -> Column:
    """Tags that begin a block become line breaks, other tags go, common entities are decoded."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<(br|div|li|p|td|th|tr)\b[^>]*>", "\n")
    return unescape(F.regexp_replace(c, r"<[^>]*>", ""))


def extract_fixed_labels(cells: DataFrame, labels: list[str], identities: dict[str, str], dates: tuple[str, str] | None = None, values: tuple[str, ...] = ()) -> DataFrame:
    """key, ok, reason, and a column per label, from cells(key, row, label, value). Checked in this order: the labels are
    exactly these, in this order (`labels`); the identities are as expected (`identity`); the two named dates are there
    and equal (`date`); the named values are between 0 and a million (`value`)."""
    per = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("row", "label"))).alias("seen"), *[F.max(F.when(F.col("label") == x, F.col("value"))).alias(x) for x in labels])
    reason = F.when(F.transform("seen", lambda x: x["label"]) != F.array(*map(F.lit, labels)), "labels")
    for name, value in identities.items():
        reason = reason.when(~F.col(name).eqNullSafe(F.lit(value)), "identity")
    if dates:
        said, table = (parse_date(d) for d in dates)
        reason = reason.when(said.isNull() | table.isNull() | (said != table), "date")
    for v in values:
        reason = reason.when(parse_number(v).isNull(), "value")
    return per.select("key", reason.isNull().alias("ok"), reason.alias("reason"), *labels)


PARTS = ["subject", "plain", "html", "attachments"]


def read_messages_rows(messages: DataFrame) -> DataFrame:
    """message_id, rows, reason (null unless the message failed), files (attachments without records or that failed).
    Columns: message_id, subject, plain, html (each a text or an array of texts) and, if there are any, attachments (an
    array of structs with suffix and payload)."""
    return read_rows(messages, "message_id", [c for c in PARTS if c in messages.columns], read_message)


def extract_observations(messages: DataFrame) -> DataFrame:
    """Observations of the text, the HTML tables, the HTML text and the delimited attachments of messages; equal rows of a
    message once. A message gives none if one of its parts fails: an ambiguous table, bad spans, a label twice, an
    attachment that can't be read, or more than the limits on a part."""
    return observed(read_messages_rows(messages), "message_id")


def extraction_report(messages: DataFrame) -> DataFrame:
    """message_id, failed, suffix, status, reason: one row per attachment without records or that failed, and one with
    nulls for other messages that failed."""
    read = read_messages_rows(messages).select("message_id", F.col("reason").isNotNull().alias("failed"), F.explode_outer("files").alias("d"))
    return read.select("message_id", "failed", "d.suffix", "d.status", "d.reason").where(F.col("failed") | F.col("status").isNotNull())


def valid_row(row, source: str) -> Row:
    """An extractor's row, as (nav_date, unit, cumulative, code) or a mapping of these, checked as to types and ranges."""
    try:
        d, u, c, k = [row.get(x) for x in ("nav_date", "unit", "cumulative", "code")] if isinstance(row, dict) else row
    except (TypeError, ValueError):
        raise Refused("not a row", "invalid-row") from None
    numeric = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x < 1_000_000
    if isinstance(d, dt.datetime) or not isinstance(d, dt.date):
        raise Refused("date", "invalid-date")
    if not numeric(u):
        raise Refused("unit", "invalid-unit")
    if c is not None and not numeric(c):
        raise Refused("cumulative", "invalid-cumulative")
    if k is not None and not isinstance(k, str):
        raise Refused("code", "invalid-code")
    return Row(d, float(u), None if c is None else float(c), code(k), source)


def register_extractor(name: str, extractor: Extractor) -> None:
    """A user's function from a message (a dict of subject, plain, html, attachments) to rows, under a name that routes can
    ask for. Names are of small letters, digits, _ and -, and begin with a letter; `auto` is the built-in one."""
    if not re.fullmatch(r"[a-z][a-z0-9_-]{0,63}", name) or name == "auto":
        raise ValueError(f"not a name for an extractor: {name}")
    EXTRACTORS[name] = extractor


def run_all(names: list[str], known: dict[str, Extractor]) -> Callable[[dict], Read]:
    """All extractors on a message: each must give rows, and only valid ones."""

    def reader(message: dict) -> Read:
        rows: list[Row] = []
        for name in names:
            if name == "auto":
                read = read_message(message)
                own, reason = read.rows, read.reason
            else:
                try:
                    own, reason = [valid_row(r, name) for r in known[name](message)], None
                except Refused as e:
                    own, reason = [], e.reason
                except Exception as e:  # noqa: BLE001 - a user's code may fail in any way; the message is refused and reported
                    own, reason = [], f"failed: {type(e).__name__}"
            if reason or not own:
                return Read([], f"{name}: {reason or 'no-rows'}")
            rows += own
        return Read(distinct(rows))

    return reader


def extractor_read(messages: DataFrame, names: list[str]) -> DataFrame:
    """message_id, rows, reason of all named extractors, in one pass over the messages."""
    if unknown := [n for n in names if n != "auto" and n not in EXTRACTORS]:
        raise ValueError(f"unknown extractors: {unknown}")
    known = {n: EXTRACTORS[n] for n in names if n != "auto"}
    return read_rows(messages, "message_id", [c for c in PARTS if c in messages.columns], run_all(names, known))


def run_extractors(messages: DataFrame, names: list[str]) -> DataFrame:
    """Observations of messages on which all of the named extractors give rows, equal rows of a message once (the last
    extractor's stays)."""
    return observed(extractor_read(messages, names), "message_id")


def extractor_failures(messages: DataFrame, names: list[str]) -> DataFrame:
    """message_id, reason: the first extractor that gave no rows or a row of wrong types, and why."""
    return extractor_read(messages, names).where("reason is not null").select("message_id", "reason")
