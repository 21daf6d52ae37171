"""Scalar text functions as Column expressions. Character classes are Unicode-aware where they stand for white space or digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import words
from marginalia.functions.columns import any_substring, let

WORD = r"[A-Za-z0-9']+"
#: White space of Unicode and the four separators U+001C to U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]"
WRAPPERS = r"\"'`()\[\]{}<>"
STOPS = r".,;:!?"
#: Line ends at which texts are split into lines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(c: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACES}+", " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


def tokens(c: Column) -> Column:
    """Lower-cased word runs of three or more characters, in order, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)), F.lower), lambda t: F.length(t) >= 3)


def content_tokens(c: Column) -> Column:
    """tokens() without words of little weight; all tokens if none is left."""
    low = F.array(*map(F.lit, words.LOW_SIGNAL))
    return let(tokens(c), lambda t: let(F.filter(t, lambda x: ~F.array_contains(low, x)), lambda f: F.when(F.size(f) == 0, t).otherwise(f)))


def literal_terms(c: Column) -> Column:
    """Blank-separated parts of four or more characters that contain one of . / _ -, without wrapping punctuation, lower-cased."""
    trimmed = lambda x: F.regexp_replace(x, rf"^[{WRAPPERS}{STOPS}]+|[{WRAPPERS}{STOPS}]+$", "")
    parts = F.transform(F.split(collapse(F.coalesce(c, F.lit(""))), " "), trimmed)
    return F.transform(F.filter(parts, lambda x: (F.length(x) >= 4) & x.rlike(r"[./_\-]")), F.lower)


def trim_snippet(c: Column, most: int = 220) -> Column:
    return let(collapse(c), lambda x: F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("..."))).otherwise(x))


def lines(c: Column) -> Column:
    """The lines of a text; no empty last line after a final line end, and none for an empty text."""
    parts = F.split(c, LINE_ENDS, -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def first_nonempty_line(c: Column, most: int = 200) -> Column:
    found = F.filter(F.transform(lines(F.coalesce(c, F.lit(""))), strip), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(found, F.lit(1)), 1, most), F.lit(""))


def preview(all_lines: Column) -> Column:
    """struct(text, line): the first non-blank line, stripped, with its number from 1; nulls if there is none."""
    numbered = F.transform(all_lines, lambda x, i: F.struct(strip(x).alias("text"), (i + 1).alias("line")))
    return F.try_element_at(F.filter(numbered, lambda s: s["text"] != ""), F.lit(1))


def heading_before(all_lines: Column, start_line: Column) -> Column:
    """The nearest heading line before start_line, without its #; null if it is empty or there is none."""
    earlier = F.filter(F.slice(all_lines, F.lit(1), F.greatest(start_line - 1, F.lit(0))), lambda x: x.startswith("#"))
    return F.nullif(strip(F.regexp_replace(F.try_element_at(earlier, F.lit(-1)), "^#+", "")), F.lit(""))


def query_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(any_substring(low, words.FILENAME_PHRASES), "filename_focus").when(any_substring(low, words.SNIPPET_PHRASES), "snippet_focus").otherwise("mixed")


def clean_path_hint(c: Column) -> Column:
    inner = F.regexp_replace(strip(c), rf"^[{WRAPPERS}]+|[{WRAPPERS}]+$", "")
    return F.translate(F.regexp_replace(inner, rf"[{STOPS}]+$", ""), "\\", "/")


def ordinal(c: Column) -> Column:
    """first ... tenth, or one or two digits with an ending; else null."""
    raw = F.lower(strip(c))
    word = F.array_position(F.array(*map(F.lit, words.ORDINALS)), raw).cast("int")
    digits = F.regexp_extract(raw, r"^(\d{1,2})(?:st|nd|rd|th)?$", 1)
    return F.when(word > 0, word).when(digits != "", digits.try_cast("int"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix, a final one neither."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def chunk_id(path: Column, mtime: Column, index: Column) -> Column:
    """A stable id; the time enters in milliseconds."""
    return F.sha1(F.concat_ws("::", path, F.round(mtime * 1000).cast("long").cast("string"), index.cast("string")).cast("binary"))


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\n"), text), 256)


def clock(seconds: Column) -> Column:
    """mm:ss or h:mm:ss; --:-- for negative or endless times."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    bad = seconds.isNull() | (seconds < 0) | F.isnan(seconds) | (seconds == float("inf"))
    return F.when(bad, "--:--").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def line_of(text: Column, offset: Column) -> Column:
    """The line number (from 1) of a character offset; only \\n ends lines here."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def decode(content: Column) -> Column:
    """Bytes to text: malformed UTF-8 is replaced, and all line ends become \\n."""
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "\r\n?", "\n")
