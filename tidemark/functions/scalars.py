"""Column functions: parsing of dates, numbers, codes and headers, identities and calendar keys. All built from
built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header words of notices by meaning, in the order in which they are tried.
HEADER_WORDS: dict[str, tuple[str, ...]] = {
    "cumulative": ("累计单位净值", "累计净值", "cumulativenav", "accumulatednav"),
    "date": ("净值日期", "估值日期", "估值基准日", "业务日期", "navdate", "date", "日期"),
    "code": ("产品代码", "基金代码", "productcode", "fundcode", "代码"),
    "unit": ("单位净值", "份额净值", "最新净值", "unitnav", "nav"),
}
# Header words of sheets by role.
SHEET_WORDS: dict[str, tuple[str, ...]] = {
    "date": ("净值日期", "估值日期", "业务日期", "nav date", "date", "日期"),
    "code": ("产品代码", "基金代码", "product code", "fund code", "代码"),
    "name": ("产品名称", "基金名称", "product name", "fund name", "名称"),
    "unit": ("单位净值", "份额净值", "unit nav"),
    "cumulative": ("累计单位净值", "累计净值", "cumulative nav"),
    "return": ("产品收益", "基金收益", "return"),
    "daily_return": ("日收益", "日度收益", "收益（日度）", "daily return"),
    "weekly_return": ("周收益", "周度收益", "收益（周度）", "weekly return"),
    "benchmark_level": ("指数点位", "基准点位", "benchmark level", "index level"),
    "benchmark_return": ("指数收益", "基准收益", "benchmark return", "index return"),
    "excess": ("超额", "excess", "alpha"),
}
#: Roles that are tried before and after the words of a benchmark.
FIRST_ROLES = ("cumulative", "date", "code", "name", "excess")
LAST_ROLES = ("benchmark_return", "benchmark_level", "daily_return", "weekly_return", "return", "unit")
# Words of a benchmark, of its return and of its level; words that mark a return, longest first.
BENCHMARK_WORDS, RETURN_WORDS, LEVEL_WORDS = ("指数", "基准"), ("日收益", "周收益", "收益率", "收益", "return"), ("点位", "收盘", "level", "close")
RETURN_MARKS = ("dailyreturn", "weeklyreturn", "benchmarkreturn", "indexreturn", "日收益率", "周收益率", "日收益", "周收益", "收益率", "收益", "return")


def text(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def normalize_code(c) -> Column:
    """Letters and digits of ASCII, upper case; nothing left: null."""
    return F.nullif(F.upper(F.regexp_replace(text(c), "[^A-Za-z0-9]", "")), F.lit(""))


def parse_number(c) -> Column:
    """A plain positive number below a million, commas (also full-width) removed; anything else is null."""
    plain = F.trim(F.translate(text(c), ",，", ""))
    value = F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("double"))
    return F.when((value > 0) & (value < 1_000_000), value)


def parse_date(c, pivot: int = 80) -> Column:
    """The first pattern that matches decides; if its date doesn't exist the result is null.

    Patterns: a serial day number above 20000 and below 100000; year, month and day of this century, with or without
    - . / 年 月 日 between; six digits in all, whatever stands between them (years from `pivot` on are of the 1900s)."""
    t = F.trim(text(c))
    serial = t.rlike(r"^\d{5}(\.\d+)?$") & t.try_cast("double").between(20000.5, 99999.5)
    by_serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(t.try_cast("double")).cast("int"))
    even = F.translate(t, "年月/.日", "----")  # without the last one
    ymd = r"(20\d{2})-?(\d{1,2})-?(\d{1,2})"
    whole = F.regexp_extract(even, rf"(?<!\d){ymd}(?!\d)", 0)
    digits = F.regexp_replace(t, r"\D", "")
    two = F.substring(digits, 1, 2)
    century = F.when(two >= F.lit(f"{pivot:02d}"), "19").otherwise("20")
    six = F.concat(century, two, F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2))
    dated = lambda said: F.try_to_date(said, "yyyy-M-d")
    return F.when(serial, by_serial).when(whole != "", dated(F.regexp_replace(whole, f"^{ymd}$", "$1-$2-$3"))).when(F.length(digits) == 6, dated(six))


def normalize_header(c) -> Column:
    return F.lower(F.regexp_replace(text(c), r"[\s_:/：()（）\[\]-]", ""))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def classify_header(c) -> Column:
    """Role of a notice's header cell: cumulative, date, code or unit, the first that matches; else null."""
    name, role = normalize_header(c), None
    for kind, words in HEADER_WORDS.items():
        role = F.when(has_any(name, words), kind) if role is None else role.when(has_any(name, words), kind)
    return role


def words_in(name: Column, words: tuple[str, ...]) -> Column:
    """Whether a normalised header holds one of the words, which are normalised alike."""
    return has_any(name, tuple(re.sub(r"[\s_:/：()（）\[\]-]", "", w).lower() for w in words))


def classify_sheet_header(c, display_name: Column | None = None) -> Column:
    """Role of a sheet's header cell. After the roles of FIRST_ROLES, a header that names an index or holds the display
    name of the benchmark is its return if it speaks of a return, else its level if it speaks of a level or is the
    display name; then the roles of LAST_ROLES follow."""
    name = normalize_header(c)
    shown = normalize_header(F.coalesce(display_name, F.lit(""))) if display_name is not None else F.lit("")
    marked = has_any(name, BENCHMARK_WORDS) | ((shown != "") & name.contains(shown))
    role = F.when(F.coalesce(name, F.lit("")) == "", F.lit(None).cast("string"))
    for kind in FIRST_ROLES:
        role = role.when(words_in(name, SHEET_WORDS[kind]), kind)
    role = role.when(marked & has_any(name, RETURN_WORDS), "benchmark_return")
    role = role.when(marked & (has_any(name, LEVEL_WORDS) | ((shown != "") & (name == shown))), "benchmark_level")
    for kind in LAST_ROLES:
        role = role.when(words_in(name, SHEET_WORDS[kind]), kind)
    return role


def return_header_base(c) -> Column:
    """What is left of a header without its words for returns: "X (daily return)" pairs with "X"."""
    name = normalize_header(c)
    for mark in RETURN_MARKS:
        name = F.replace(name, F.lit(mark), F.lit(""))
    return name


def short_id(*cols) -> Column:
    """First 12 hex digits of the SHA-256 of the values, joined by the unit separator; null counts as ''."""
    joined = F.concat_ws("\x1f", *[F.coalesce(text(c).cast("string"), F.lit("")) for c in cols])
    return F.substring(F.sha2(joined, 256), 1, 12)


def effective_cumulative(unit, cumulative, policy, offset) -> Column:
    """Given cumulative value, else by policy: `unit` takes the unit value, `offset` adds the offset, `require` is null
    (the caller reports it)."""
    by_policy = F.when(text(policy) == "unit", text(unit)).when(text(policy) == "offset", text(unit) + text(offset))
    return F.coalesce(text(cumulative), by_policy)


def row_signature(unit, cumulative, digits: int = 10) -> Column:
    return F.struct(F.bround(text(unit), digits).alias("unit"), F.bround(text(cumulative), digits).alias("cumulative"))


def iso_week(d) -> Column:
    """Monday of the date's week."""
    return F.date_trunc("WEEK", text(d)).cast("date")


def is_completed_week(d, as_of: Column) -> Column:
    return iso_week(d) < iso_week(as_of)


def message_order(uid, sent_at) -> Column:
    """struct(kind, ord): mailbox number if positive, else microseconds of the date, else null."""
    by_uid = F.when(text(uid) > 0, F.struct(F.lit("mailbox-uid").alias("kind"), text(uid).cast("long").alias("ord")))
    by_date = F.when(text(sent_at).isNotNull(), F.struct(F.lit("message-date").alias("kind"), F.unix_micros(text(sent_at).cast("timestamp")).alias("ord")))
    return F.coalesce(by_uid, by_date)


def column_letter(n) -> Column:
    """Spreadsheet letters of a 1-based column number, up to three letters."""
    n = text(n).cast("int")
    one = n - 1
    two = F.floor((n - 27) / 26).cast("int")
    three = F.floor((n - 703) / 676).cast("int")
    letter = lambda i: F.chr(F.lit(65) + i)
    return (
        F.when(n < 1, None)
        .when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(two), letter((n - 27) % 26)))
        .otherwise(F.concat(letter(three), letter(F.floor((n - 703) / 26).cast("int") % 26), letter((n - 703) % 26)))
    )


def column_index(letters) -> Column:
    chars = F.filter(F.split(F.upper(text(letters)), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def payload_fingerprint(*cols) -> Column:
    """SHA-256 of the JSON of the columns in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def typed_cell_hash(kind, value) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.coalesce(text(kind), F.lit("")), F.coalesce(text(value), F.lit(""))), 256)


def unique_date_in_text(c) -> Column:
    """The date in a text if it names exactly one of this century."""
    found = F.regexp_extract_all(text(c), F.lit(r"(20\d{2})\s*[-./年]\s*(\d{1,2})\s*[-./月]\s*(\d{1,2})"), F.lit(0))
    dates = F.array_distinct(F.filter(F.transform(found, lambda x: parse_date(x)), lambda d: d.isNotNull()))
    return F.when(F.size(dates) == 1, F.get(dates, F.lit(0)))


def sign_bucket(value, threshold: float = 5e-5) -> Column:
    v = text(value)
    return F.when(v.isNull(), None).when(v >= threshold, "positive").when(v <= -threshold, "negative").otherwise("zero")


def source_type(c) -> Column:
    """Class of an observation's source by the first token that it holds."""
    kind = F.when(F.lit(False), F.lit(""))
    for token in ("xlsx", "xls", "csv", "pdf", "html", "body", "text", "subject-code"):
        kind = kind.when(F.lower(text(c)).contains(token), token)
    return kind.otherwise("parser-output")
