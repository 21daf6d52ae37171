"""Listing, finding, resolving and reading notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T


def find_files(notes: DataFrame, term: str, mode: str = "both", limit: int = 100) -> DataFrame:
    """rel_path, filename_match, text_match of the first notes, by path, whose path or text contains the term. In mode filename no text is read."""
    if mode not in ("filename", "text", "both"):
        raise ValueError(f"mode must be filename, text or both, not {mode!r}")
    needle = term.strip().lower()
    in_name = F.lower("rel_path").contains(needle)
    in_text = F.lit(False) if mode == "filename" else F.coalesce(F.lower("text").contains(needle), F.lit(False))
    x = notes.select("rel_path", in_name.alias("filename_match"), in_text.alias("text_match"))
    wanted = {"filename": F.col("filename_match"), "text": F.col("text_match"), "both": F.col("filename_match") | F.col("text_match")}[mode]
    return x.where(wanted & F.lit(bool(needle))).orderBy("rel_path").limit(limit)


def page(files: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of paths in order, with the total and whether more follow."""
    total = files.agg(F.count(F.lit(1)).alias("total"))
    rows = files.select("rel_path").orderBy("rel_path").offset(offset).limit(limit)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def large_files(files: DataFrame, min_size_mb: float, limit: int = 100) -> DataFrame:
    """files: rel_path, size. Files of at least a size, by path."""
    mb = F.round(F.col("size") / 1048576.0, 3)
    return files.where(F.col("size") >= min_size_mb * 1048576).select("rel_path", "size", mb.alias("size_mb")).orderBy("rel_path").limit(limit)


def excerpts(requests: DataFrame, notes: DataFrame, max_chars: int = 120_000) -> DataFrame:
    """requests: rel_path, start_line, end_line. The lines asked for, clamped, swapped if reversed, and cut to max_chars."""
    x = requests.join(notes.select("rel_path", T.lines(F.col("text")).alias("lines")), "rel_path")
    n = F.size("lines")
    s = F.greatest(F.lit(1), F.coalesce(F.nullif("start_line", F.lit(0)), F.lit(1)))
    e = F.least(n, F.coalesce(F.nullif("end_line", F.lit(0)), n))
    x = x.select("rel_path", "lines", F.least(s, e).alias("start_line"), F.greatest(s, e).alias("end_line"), n.alias("total_lines"))
    first = F.greatest(F.col("start_line"), F.lit(1))
    text = F.substring(F.array_join(F.slice("lines", first, F.greatest(F.lit(0), F.col("end_line") - first + 1)), "\n"), 1, max_chars)
    return x.select("rel_path", "start_line", "end_line", "total_lines", text.alias("text"), (F.length(text) >= max_chars).alias("truncated"))


def clean_hint(hint: Column) -> Column:
    """A hint as a relative path, without a leading ./"""
    return F.lower(F.regexp_replace(F.translate(T.strip(hint), "\\", "/"), r"^(\./|/)+", ""))


def resolve(hints: DataFrame, files: DataFrame, compat: bool = False) -> DataFrame:
    """hints: hint. hint, rel_path, tier of the best tier that matches: 1 the path, 2 (with compat only: the file name) or a suffix of whole parts, 3 the file name.

    A hint with folders is matched by its folders before its mere file name; compat puts the file name first, so that a suffix never decides.
    Three joins on keys, no comparison of every hint with every path: the path, its suffixes and its name are exploded into keys.
    """
    h = hints.select("hint", clean_hint(F.col("hint")).alias("_h")).where("_h <> ''")
    h = h.withColumn("_name", F.element_at(F.split("_h", "/"), -1))
    low = F.lower("rel_path")
    parts = F.split(low, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = files.select("rel_path", F.posexplode(tails).alias("_i", "_key"))
    by_path = h.join(keys, F.col("_h") == F.col("_key")).select("hint", "rel_path", F.when(F.col("_i") == 0, 1).otherwise(3 if compat else 2).alias("tier"))
    by_name = h.join(files.select("rel_path", F.element_at(parts, -1).alias("_key")), F.col("_name") == F.col("_key")).select("hint", "rel_path", F.lit(2 if compat else 3).alias("tier"))
    both = by_path.unionByName(by_name).groupBy("hint", "rel_path").agg(F.min("tier").alias("tier"))
    return both.withColumn("_best", F.min("tier").over(Window.partitionBy("hint"))).where("tier = _best").drop("_best")


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below the root."""
    return ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.startswith("/")
