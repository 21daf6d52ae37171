"""Scores between 0 and 1 of a query against texts and paths, as Column expressions.

A query's features (query_features) are computed once a query, a text's (tokens, lower, normalized) once a text, before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import words
from marginalia.functions.columns import bound, let, present


def query_features(query: Column) -> Column:
    """struct(all_tokens, toks, phrase, terms, kind, grams4, grams3, grams2)."""
    def grams(t: Column, k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= k, every).otherwise(F.array().cast("array<string>"))

    return let(T.content_tokens(query), lambda t: F.struct(
        T.tokens(query).alias("all_tokens"), t.alias("toks"), F.array_join(t, " ").alias("phrase"), T.literal_terms(query).alias("terms"), T.query_type(query).alias("kind"),
        *[grams(t, k).alias(f"grams{k}") for k in (4, 3, 2)],
    ))


def text_features(text: Column) -> Column:
    """struct(tokens, lower, norm)."""
    return F.struct(T.tokens(text).alias("tokens"), F.lower(text).alias("lower"), T.normalize(text).alias("norm"))


def _count(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def keyword(q: Column, d: Column) -> Column:
    """Multiset overlap of query tokens with text tokens, by the number of query tokens."""
    # Only shared tokens add to it, and each adds 1 if the query has no repeats.
    both = F.array_intersect(q, d)
    repeated = F.aggregate(both, F.lit(0), lambda acc, t: acc + F.least(_count(q, t), _count(d, t)))
    shared = F.when(F.size(F.array_distinct(q)) == F.size(q), F.size(both)).otherwise(repeated)
    return F.when((F.size(q) == 0) | (F.size(d) == 0), F.lit(0.0)).otherwise(shared / F.greatest(F.size(q), F.lit(1)))


def text_match(phrase: Column, q: Column, lower: Column, d: Column) -> Column:
    """1 if the text contains the phrase, else the share of distinct query tokens in it."""
    distinct = F.array_distinct(q)
    return F.when((phrase == "") | (lower == ""), 0.0).when(lower.contains(phrase), 1.0).otherwise(F.size(F.array_intersect(q, d)) / F.greatest(F.size(distinct), F.lit(1)))


def phrase_match(q: Column, norm: Column) -> Column:
    """q: query features. The whole phrase, or its longest run of four to two tokens that the text contains."""
    has = lambda grams: F.exists(grams, lambda g: norm.contains(g))
    return (
        F.when((q["phrase"] == "") | (norm == ""), 0.0).when(norm.contains(q["phrase"]), 1.0)
        # A text without any of the shorter runs has none of the longer ones.
        .when(~has(q["grams2"]), 0.0).when(~has(q["grams3"]), 0.62).when(~has(q["grams4"]), 0.78).otherwise(0.9)
    )


def ordered_match(q: Column, norm: Column) -> Column:
    """The longest prefix of the tokens that the text contains in order, by the number of tokens."""
    # One number for each step: the place to go on from times 2^31, and how many were found; after the first that is not found, -1 less how many.
    high = F.lit(1 << 31)

    def step(acc: Column, t: Column) -> Column:
        at = F.call_function("locate", t, norm, F.shiftright(acc, 31).cast("int"))
        return F.when(acc < 0, acc).when(at > 0, (at + F.length(t)) * high + F.pmod(acc, high) + 1).otherwise(-1 - F.pmod(acc, high))

    found = F.aggregate(q, high, step, lambda acc: F.when(acc < 0, -1 - acc).otherwise(F.pmod(acc, high)))
    return F.when((F.size(q) == 0) | (norm == ""), 0.0).otherwise(found / F.greatest(F.size(q), F.lit(1)))


def literal_match(terms: Column, lower: Column) -> Column:
    hits = F.size(F.filter(terms, lambda t: lower.contains(t)))
    return F.when((F.size(terms) == 0) | (lower == ""), 0.0).otherwise(hits / F.greatest(F.size(terms), F.lit(1)))


def line_relevance(q: Column, d: Column) -> Column:
    """q: query features, d: text features of a line."""
    return F.when(d["norm"] == "", 0.0).otherwise(F.greatest(phrase_match(q, d["norm"]), text_match(q["phrase"], q["toks"], d["lower"], d["tokens"]), keyword(q["toks"], d["tokens"])))


def path_features(path: Column) -> Column:
    """struct(lower, tokens, stem, stem_tokens, penalty) for filename_match."""
    stem = F.lower(T.stem(path))
    artifacts = F.array(*map(F.lit, words.ARTIFACTS))
    return F.struct(
        F.lower(path).alias("lower"), F.array_distinct(T.tokens(F.translate(path, "/", " "))).alias("tokens"), stem.alias("stem"), T.tokens(stem).alias("stem_tokens"),
        (F.when(stem.contains("."), 0.06).otherwise(0.0) + F.when(F.arrays_overlap(T.tokens(stem), artifacts), 0.08).otherwise(0.0)).alias("penalty"),
    )


def filename_match(q: Column, p: Column) -> Column:
    """q: query features, p: path features. Four tiers: the stem itself, a whole word in it, a substring of stem or path, tokens."""
    terms = F.array_distinct(q["toks"])
    n = F.size(terms)
    common = F.size(F.array_intersect(terms, p["tokens"]))
    overlap, specific = common / F.greatest(n, F.lit(1)), common / F.greatest(F.size(p["tokens"]), F.lit(1))
    extra = F.greatest(F.lit(0), F.size(p["stem_tokens"]) - n)
    compact = 1 - F.least(extra, F.lit(6)) / 6.0
    brief = 1 - F.least(F.length(p["stem"]), F.lit(80)) / 80.0
    spaced = F.when(p["stem"].contains(" "), 0.05).otherwise(0.0)
    own = F.array_distinct(p["stem_tokens"])
    shared = F.size(F.array_intersect(terms, own))
    same = F.when((shared == n) & (F.size(own) == n), 0.03).otherwise(0.0)
    all_there = F.when(shared == n, 0.02).otherwise(0.0)
    word = F.regexp_like(p["stem"], F.concat(F.lit(r"(?<![a-z0-9])\Q"), q["phrase"], F.lit(r"\E(?![a-z0-9])")))
    part = p["stem"].contains(q["phrase"]) | p["lower"].contains(q["phrase"])

    def clamp(most: float, value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(most), value - p["penalty"]))

    return (
        F.when((q["phrase"] == "") | (n == 0) | (F.size(p["tokens"]) == 0), 0.0)
        .when(p["stem"] == q["phrase"], clamp(1.0, F.lit(0.995)))
        .when(word, clamp(0.99, 0.74 + 0.08 * compact + 0.08 * brief + spaced + same + all_there))
        .when(part, clamp(0.90, 0.68 + 0.10 * overlap + 0.10 * specific + 0.08 * brief + 0.04 * compact + spaced))
        .otherwise(clamp(0.85, 0.58 * overlap + 0.24 * specific + 0.18 * compact + spaced))
    )


def metadata_text(path: Column, heading: Column, first_line: Column) -> Column:
    parts = [F.nullif(x, F.lit("")) for x in (T.basename(path), T.stem(path), heading, first_line)]
    return T.strip(F.concat_ws(" ", *parts))


def metadata_match(q: Column, d: Column) -> Column:
    """d: text features of metadata_text."""
    best = F.greatest(phrase_match(q, d["norm"]), ordered_match(q["toks"], d["norm"]), text_match(q["phrase"], q["toks"], d["lower"], d["tokens"]), keyword(q["toks"], d["tokens"]))
    return F.when(d["norm"] == "", 0.0).otherwise(best)


def rank_score(rank: Column, total: Column) -> Column:
    return F.when(total <= 1, 1.0).otherwise(1 - (rank - 1) / F.greatest(total - 1, F.lit(1)))


def combine(kind: Column, **scores: Column) -> Column:
    """The weighted sum of semantic, keyword, filename, text, metadata and phrase, by query type."""
    def total(w: dict) -> Column:
        out = w["semantic"] * scores["semantic"]
        for name in ("keyword", "filename", "text", "metadata", "phrase"):
            out = out + w[name] * scores[name]
        return out

    by = words.WEIGHTS
    return F.when(kind == "filename_focus", total(by["filename_focus"])).when(kind == "snippet_focus", total(by["snippet_focus"])).otherwise(total(by["mixed"]))


def reasons(**s: Column) -> Column:
    at = (("filename", "filename", 0.45), ("phrase", "phrase", 0.60), ("heading", "metadata", 0.45), ("text", "text", 0.45), ("keyword", "keyword", 0.35), ("semantic", "semantic", 0.45))
    return let(present(*[F.when(s[key] >= least, F.lit(name)) for name, key, least in at]), lambda r: F.when(F.size(r) == 0, F.array(F.lit("semantic"))).otherwise(r))


def line_quality(line: Column, tokens: Column, norm: Column) -> Column:
    listed = let(T.strip(line), lambda bare: bare.startswith("#") | bare.startswith("-") | bare.endswith(":"))
    mark = F.when(listed, 0.18).when(F.size(tokens) <= 6, 0.10).otherwise(0.0)
    return F.least(F.lit(0.30), mark + 0.12 * F.greatest(F.lit(0.0), 1 - F.least(F.length(norm), F.lit(180)) / 180.0))


def best_of_lines(rows: DataFrame) -> DataFrame:
    """rows: query_id, rel_path, line, content, q (query features), d (text features of content). The best line of each query and rel_path with its scores.

    One row a line and query, whose maximum by score and tie-breaks is taken with partial aggregation.
    """
    return best_of_notes(line_scores(rows))


def line_scores(rows: DataFrame) -> DataFrame:
    """rows with BY; all but the quality, which rows may have already, are 0 where q is null."""
    q, d = F.col("q"), F.col("d")
    scores = {
        "phrase": phrase_match(q, d["norm"]), "text": text_match(q["phrase"], q["toks"], d["lower"], d["tokens"]), "keyword": keyword(q["toks"], d["tokens"]),
        "literal": literal_match(q["terms"], d["lower"]), "ordered": ordered_match(q["toks"], d["norm"]),
    }
    known = {} if "quality" in rows.columns else {"quality": line_quality(F.col("content"), d["tokens"], d["norm"])}
    x = bound(rows, **known, **{k: F.when(q.isNull(), 0.0).otherwise(v) for k, v in scores.items()})
    return x.withColumn("score", F.greatest("phrase", "text", "keyword", "ordered", "literal"))


#: What decides between lines, after it the earlier one.
BY = ("score", "literal", "phrase", "ordered", "text", "keyword", "quality")


def best_of_notes(rows: DataFrame) -> DataFrame:
    """rows: query_id, rel_path, line and BY. The best of each query and rel_path."""
    order = F.struct(*BY, (-F.col("line")).alias("back"))
    return rows.groupBy("query_id", "rel_path").agg(F.max(order).alias("b")).select("query_id", "rel_path", "b.*").withColumn("line", -F.col("back")).drop("back")


def text_candidate(kind: Column, filename: Column, metadata: Column, phrase: Column, text: Column, keyword: Column, quality: Column, ordered: Column, literal: Column) -> Column:
    """The first rung of the ladder that fits decides."""
    cap = lambda most, value: F.least(F.lit(most), value)
    snippet = kind == "snippet_focus"
    return (
        F.when((literal >= 0.99) & (ordered >= 0.99), cap(0.995, 0.84 + 0.05 * literal + 0.04 * ordered + 0.05 * quality + 0.03 * filename + 0.03 * metadata))
        .when((literal >= 0.99) & ((text >= 0.95) | (keyword >= 0.95)), cap(0.985, 0.80 + 0.05 * literal + 0.04 * text + 0.03 * keyword + 0.05 * quality + 0.02 * filename))
        .when((phrase >= 0.99) & (ordered >= 0.99) & (quality >= 0.18), cap(0.992, 0.82 + 0.05 * phrase + 0.04 * ordered + 0.06 * quality + 0.03 * filename + 0.03 * metadata))
        .when((ordered >= 0.99) & (quality >= 0.18), cap(0.975, 0.79 + 0.05 * ordered + 0.06 * quality + 0.03 * metadata + 0.02 * filename))
        .when(ordered >= 0.99, cap(0.965, 0.77 + 0.05 * ordered + 0.04 * quality + 0.03 * metadata))
        .when(phrase >= 0.99, cap(0.96, 0.76 + 0.05 * phrase + 0.04 * quality + 0.03 * metadata + 0.02 * filename))
        .when((text >= 0.99) & (keyword >= 0.99), cap(0.93, 0.72 + 0.04 * text + 0.04 * keyword + 0.06 * quality + 0.03 * metadata + 0.02 * filename))
        .when((phrase >= 0.62) & (text >= 0.80), cap(0.985, F.when(snippet, 0.93).otherwise(0.89) + quality))
        .when(snippet, cap(0.98, 0.58 * phrase + 0.24 * text + 0.12 * keyword + 0.06 * metadata + 0.08 * filename + quality + 0.04 * ordered))
        .otherwise(cap(0.90, 0.48 * phrase + 0.22 * text + 0.10 * keyword + 0.10 * metadata + 0.10 * filename + quality + 0.06 * ordered + 0.04 * literal))
    )
