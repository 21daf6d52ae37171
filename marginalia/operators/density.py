"""Counts of addresses, links, keys, card numbers and SQL statements in each note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import words
from marginalia.functions.columns import let

#: Names of what is counted, as they stand in reports.
LABELS = {"ip": "IPv4 address", "email": "email address", "url": "URL", "api_key": "API-key-like string", "credit_card": "credit-card-like number", "sql": "SQL statement"}


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern if "(?i" in pattern else "(?U)" + pattern), F.lit(group))


def ip(text: Column) -> Column:
    return F.filter(_all(text, words.IPV4), lambda a: F.forall(F.split(a, "[.]"), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False))))


def email(text: Column) -> Column:
    return F.transform(_all(text, words.EMAIL), F.lower)


def url(text: Column) -> Column:
    return F.filter(F.transform(_all(text, words.URL), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")), lambda u: u != "")


def api_key(text: Column) -> Column:
    return F.concat(*[_all(text, p) for p in words.API_KEYS])


def credit_card(text: Column) -> Column:
    digits = F.transform(_all(text, words.CARD), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.filter(digits, lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def sql(text: Column) -> Column:
    """Statements that end in a semicolon, and single lines without one; a text may be counted by both."""
    block = _all(text, words.SQL_BLOCK.replace("(?is)", "(?isUd)"), 1)
    line = _all(text, words.SQL_LINE.replace("(?im)", "(?imUd)"))
    reads = lambda s: s.startswith("select") | s.startswith("with")
    whole = F.transform(F.concat(block, line), lambda s: F.lower(T.strip(s)))
    kept = F.filter(whole, lambda s: (s != "") & ~(reads(s) & ~s.contains(" from ")))
    return F.transform(kept, T.collapse)


ANALYZERS = {"ip": ip, "email": email, "url": url, "api_key": api_key, "credit_card": credit_card, "sql": sql}


def density(notes: DataFrame, target: str) -> DataFrame:
    """notes: rel_path, text. rel_path, total, distinct of the notes with a match."""
    found = ANALYZERS[target](F.col("text"))
    counts = let(found, lambda m: F.struct(F.size(m).alias("total"), F.size(F.array_distinct(m)).alias("distinct")))
    out = notes.select("rel_path", counts.alias("c")).select("rel_path", F.col("c")["total"].cast("long").alias("total"), F.col("c")["distinct"].cast("long").alias("uniques"))
    return out.where("total > 0")


def densest(notes: DataFrame, target: str, most: int = 10) -> DataFrame:
    """The notes with most matches; ties by distinct matches, then by path, all descending."""
    return density(notes, target).orderBy(F.desc("total"), F.desc("uniques"), F.desc("rel_path")).limit(most)


def report(notes: DataFrame, target: str, most: int = 10) -> str:
    """The densest notes as text, with how many more there are."""
    found = density(notes, target)
    rows, label = densest(notes, target, most).collect(), LABELS[target]
    if not rows:
        return f"No indexed files contain {label}s."
    total = found.count()
    lines = [f"Top files by {label} count ({total} file(s) with at least one match):", *(f"- {r.rel_path}: {r.total} match(es), {r.uniques} unique" for r in rows)]
    return "\n".join(lines + ([f"... ({total - most} more)"] if total > most else []))
