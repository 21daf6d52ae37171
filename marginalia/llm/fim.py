r"""Fill-in-the-middle transformation by escaped marker injection, in Spark's own functions alone.

Units are the matches of [A-Za-z]+|[^A-Za-z], so any two cuts between units leave words whole. To cut a text at counted units without
taking it apart: the control characters U+0001 (delimiter) and U+0002 (escape) are escaped in the text, regexp_replace appends the
delimiter after each unit (an escaped character is one unit), the delimiters are counted, and substring_index extracts the parts of given
rank, which are freed of delimiters and unescaped. The work is linear in the text, and nothing is exploded into rows.

A document's cuts, form and order come from the SHA-256 of a seed and its id, so they can be repeated on any cluster:
  psm   <P>prefix<S>suffix<M>middle
  spm   <S>suffix<P>prefix<M>middle
  plain the text as it is: an empty text, a text that contains one of the markers, and the share PLAIN_PERCENT of all documents.
restored() takes an output apart by its markers: none of them can stand in a part, and none can arise where two parts meet, since each
begins with the only < and ends with the only > of a marker.

Edge cases: a null text counts as empty; a null id is hashed as an empty one; rows that repeat get the same result each; very long texts are
cut like others; an empty table gives no rows. Other columns pass through; those with the name of a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import giving_way, with_let

DELIMITER, ESCAPE = "\u0001", "\u0002"
UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, "1:"
RESULT = ("n", "form", "prefix", "middle", "suffix", "output")


def marked(text: Column) -> Column:
    """text with a delimiter after each unit; characters that mean something here are escaped."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))
    return F.regexp_replace(safe, UNIT, "$0" + DELIMITER)


def unmarked(part: Column) -> Column:
    whole = F.replace(F.replace(part, F.lit(DELIMITER), F.lit("")), F.lit(ESCAPE + "1"), F.lit(DELIMITER))
    return F.replace(whole, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def count_units(marks: Column) -> Column:
    return F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit(DELIMITER), F.lit("")))


def _ranked(marks: Column, count: Column) -> Column:
    """The first count parts, or the last -count."""
    return F.call_function("substring_index", marks, F.lit(DELIMITER), count.cast("int"))


def parts(marks: Column, n: Column, low: Column, high: Column) -> Column:
    """struct(prefix, middle, suffix) of a marked text of n units, cut after units low and high (low <= high)."""
    return F.struct(
        unmarked(_ranked(marks, low)).alias("prefix"),
        unmarked(_ranked(_ranked(marks, high), low - high)).alias("middle"),
        # The text ends in a delimiter: behind it an empty part counts as the last one.
        unmarked(_ranked(marks, high - n - 1)).alias("suffix"),
    )


def draws(row_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, row_id: str = "doc_id", text: str = "text", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED) -> DataFrame:
    """docs with n (units), form, prefix, middle, suffix (null if plain) and output."""
    docs = giving_way(docs, *[c for c in RESULT if c not in (row_id, text)])
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{row_id}`"), seed)
    unfit = (whole == "") | F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE)) | (h3 % 100 >= 100 - plain_percent)
    kind = F.when(unfit, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")

    def cut(marks: Column, n: Column) -> Column:
        one, two = h1 % (n + 1), h2 % (n + 1)
        return F.struct(n.cast("long").alias("n"), F.when(kind != "plain", parts(marks, n, F.least(one, two), F.greatest(one, two))).alias("parts"))

    # Marks and their count are made once a text; nothing of this is computed again for each column of the result.
    done = with_let(marked(whole), lambda m: with_let(count_units(m), lambda n: cut(m, n)))
    out = docs.select("*", kind.alias("form"), done.alias("_cut"))
    p = F.col("_cut.parts")
    lit = F.lit
    psm = F.concat(lit(PREFIX), p.prefix, lit(SUFFIX), p.suffix, lit(MIDDLE), p.middle)
    spm = F.concat(lit(SUFFIX), p.suffix, lit(PREFIX), p.prefix, lit(MIDDLE), p.middle)
    made = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole)
    named = {"n": F.col("_cut.n"), "form": F.col("form"), **{k: p[k] for k in ("prefix", "middle", "suffix")}, "output": made}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in named.items()])


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone."""
    index = lambda x, marker, k: F.substring_index(x, marker, k)
    head, middle = index(output, MIDDLE, 1), index(output, MIDDLE, -1)
    psm = F.concat(index(index(head, SUFFIX, 1), PREFIX, -1), middle, index(head, SUFFIX, -1))
    spm = F.concat(index(head, PREFIX, -1), middle, index(index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle() -> str:
    """DuckDB SQL of the query's rows: units as a list, parts as slices of it."""
    draw = lambda i: f"('0x' || substr(digest, {8 * i + 1}, 8))::UBIGINT::BIGINT"
    markers = " OR ".join(f"contains(whole, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    part = lambda a, b: f"array_to_string(list_slice(units, {a}, {b}), '')"
    return (
        "WITH a AS (SELECT doc_id, coalesce(text, '') whole, sha256('1:' || coalesce(doc_id::VARCHAR, '')) digest FROM documents), "
        f"b AS (SELECT *, regexp_extract_all(whole, '[A-Za-z]+|[^A-Za-z]') units, {draw(0)} h1, {draw(1)} h2, {draw(2)} h3, {draw(3)} h4 FROM a), "
        f"c AS (SELECT *, len(units) n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) hi, "
        f"CASE WHEN whole = '' OR {markers} OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END form FROM b), "
        f"d AS (SELECT *, {part(1, 'lo')} p, {part('lo + 1', 'hi')} m, {part('hi + 1', 'n')} s FROM c), "
        f"e AS (SELECT *, CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE whole END output FROM d) "
        "SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END middle_chars, "
        "sha256(output) output_sha256, sha256(whole) restored_sha256 FROM e"
    )
