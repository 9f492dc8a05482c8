"""Privacy audit of texts and paths, and garbled text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is looked for in a line.
PATTERNS: dict[str, str] = {
    "absolute-user-path": r"(?i)[A-Z]:[\\/]Users[\\/][^\\/\s]+",
    "sync-or-desktop-path": r"(?i)(OneDrive|Dropbox|Google Drive|Desktop)[\\/]",
    "credential-literal": r"""(?i)(password|passwd|api[_-]?key|secret|token)\s*[:=]\s*['"][^'"]{4,}['"]""",
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
# Domains that may be named, and names and suffixes of files that are denied or known.
ALLOWED_DOMAINS = ("example.com", "example.invalid", "users.noreply.github.com")
DENIED_NAMES = (
    "config.json", "route-report.json", "validation-report.json", "concurrency-report.json", "plan.json", "route-proposals.json",
    "automation-approval.json", "scheduled_tasks.json", "last-scheduled-run.json", "run.lock", "secret.json",
)
DENIED_SUFFIXES = ("xlsx", "xlsm", "xls", "csv", "pdf", "eml", "zip", "log", "png", "jpg", "jpeg")
KNOWN_SUFFIXES, KNOWN_NAMES = ("py", "md", "txt", "yaml", "yml", "cmd", "ps1", "lock", "gitignore", ""), ("LICENSE", ".gitignore")

HAN = re.compile("[\u3400-\u9fff]")


def categories(line: Column) -> Column:
    """Categories that a line falls into, in order."""
    found = [F.when(line.rlike(p), F.lit(name)) for name, p in PATTERNS.items()]
    mails = F.regexp_extract_all(line, F.lit(EMAIL), F.lit(0))
    foreign = F.exists(mails, lambda m: ~F.lower(F.substring_index(m, "@", -1)).isin(*ALLOWED_DOMAINS))
    return F.filter(F.array(*found, F.when(foreign, F.lit("non-example-email"))), lambda x: x.isNotNull())


def audit_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), category: once per line and category."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "said"))
    return lines.select(key, (F.col("p") + 1).alias("line"), F.explode(categories(F.col("said"))).alias("category"))


def audit_paths(df: DataFrame, key: str, path: str) -> DataFrame:
    """key, category: what audit_text finds in the path, and the first of runtime-artifact (a denied name),
    binary-or-data-artifact (a denied suffix) and unexpected-file-type (an unknown one)."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    own = F.when(name.isin(*DENIED_NAMES), "runtime-artifact").when(suffix.isin(*DENIED_SUFFIXES), "binary-or-data-artifact").when(~suffix.isin(*KNOWN_SUFFIXES) & ~name.isin(*KNOWN_NAMES), "unexpected-file-type")
    return df.select(key, F.explode(F.filter(F.concat(categories(F.col(path)), F.array(own)), lambda x: x.isNotNull())).alias("category"))


@F.pandas_udf(StringType())
def recovered(texts: pd.Series) -> pd.Series:
    """Spark's own encode knows neither GBK nor Windows-1252."""

    def again(said: str | None) -> str | None:
        if not said or said.isascii():
            return None
        for codec in ("gbk", "cp1252", "latin1"):
            try:
                text = said.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if text != said and HAN.search(text):
                return text
        return None

    return texts.map(again)


def garbled_text(c) -> Column:
    """The text recovered from UTF-8 bytes that were read as GBK, Windows-1252 or Latin-1 (the first that works), if that
    gives Chinese characters; else null."""
    return recovered(F.col(c) if isinstance(c, str) else c)


def has_replacement(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.contains("�")
