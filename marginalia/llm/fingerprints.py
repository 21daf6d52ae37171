"""Document fingerprints by Order MinHash, in its one-permutation form.

Tokens are words, runs without ASCII white space, of up to TOKEN code points; of a longer run each code point is a token, so that an edit within
it changes the tokens it touches and no later ones (text without blanks, long links, encoded data). Each K-gram
of tokens is numbered by its occurrence in the text, so that repeats count. A keyed hash of (K-gram, occurrence) deals the
numbered K-grams into BINS classes in a ring, each of which stands for one permutation of Order MinHash. For each class the PICK K-grams
of least hash are selected, put back into text order, and the ordered tuple is hashed to 16 bits. A class with fewer goes on to the least
of the classes that follow in the ring, so every value is of an ordered tuple, in short texts too. The fingerprint is the BINS values in hex; the likeness of two is
the share of equal values. Because tuples keep text order and repeats are numbered, it drops with moves and repetition as edit
distance does, and not only with changes of the set of K-grams.

One hash a K-gram instead of BINS of them is what keeps the work linear in the text. Positions and hashes are packed into single
longs, so the two sorts of each text are sorts of primitive arrays; places are exact up to 2**POS_BITS tokens, far more than an array of them could hold in a row. Everything is built-in array functions: no Python runs.

Edge cases: a null text counts as empty; a text without a token has the fingerprint of zeros, and two such are alike by 1.0; a text of fewer
than K tokens is one K-gram of all its tokens; equal texts have equal fingerprints. Documents that repeat an id are rows of their own; the next
document of all of them is the next larger id, and of an id held by several rows the one with the least text hash stands for
it. A table of one id is followed by itself; a null id comes first, as an id of its own. Only doc_id and text are read, so other columns cannot
clash; they are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import global_order, materialize, with_let

TOKEN, K, BINS, PICK = 16, 3, 64, 2
#: Bits of a packed long: position below, hash above.
POS_BITS, RANK_BITS = 26, 31
BIN_BITS = 6
#: A whole word of up to TOKEN code points, else one code point of a longer one.
TOKENS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,%d}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]" % TOKEN


def _grams(tokens: Column) -> Column:
    """The packed (hash, position) of each K-gram, sorted."""
    def packed(t: Column) -> Column:
        one = lambda h, i: F.shiftleft(h, POS_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << POS_BITS) - 1)))
        many = F.transform(F.sequence(F.lit(0), F.size(t) - K), lambda i: one(F.xxhash64(*[F.get(t, i + j) for j in range(K)]), i))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).when(F.size(t) < K, F.array(one(F.xxhash64(t), F.lit(0)))).otherwise(many)

    return F.sort_array(with_let(tokens, packed))


def _numbered(grams: Column) -> Column:
    """grams: sorted, packed. The sorted packed (bin, rank, position) of each numbered K-gram."""
    def outer(p: Column) -> Column:
        key = lambda i: F.shiftright(F.get(p, i), POS_BITS)
        heads = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (key(i) != key(i - 1)))
        ends = lambda h: F.transform(h, lambda x, j: F.sequence(F.lit(1), F.coalesce(F.get(h, j + 1), F.size(p)) - x))
        # with no repeated K-gram every occurrence is the first
        occurrence = with_let(heads, lambda h: F.when(F.size(h) == F.size(p), F.array_repeat(F.lit(1), F.size(p))).otherwise(F.flatten(ends(h))))
        rank = F.zip_with(p, occurrence, lambda x, n: F.xxhash64(F.shiftright(x, POS_BITS), n).bitwiseAND(F.lit((1 << (BIN_BITS + RANK_BITS)) - 1)))
        return F.zip_with(rank, p, lambda r, x: F.shiftleft(r, POS_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << POS_BITS) - 1))))

    return F.sort_array(with_let(grams, outer))


def _values(sorted_ranks: Column) -> Column:
    """The BINS values, each 0 to 65535, of a non-empty sorted array of packed (bin, rank, position)."""
    bin_of = lambda x: F.shiftright(x, RANK_BITS + POS_BITS)
    rank_of = lambda x: F.shiftright(x, POS_BITS).bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    pos_of = lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1))

    def outer(q: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (bin_of(F.get(q, i)) != bin_of(F.get(q, i - 1))))

        def tuple_at(i: Column) -> Column:
            # the next one in the ring; of a sole K-gram itself
            a, b = F.get(q, i), F.coalesce(F.get(q, i + 1), F.get(q, F.lit(0)))
            h = F.when(pos_of(b) < pos_of(a), F.xxhash64(rank_of(b), rank_of(a))).otherwise(F.xxhash64(rank_of(a), rank_of(b)))
            return F.struct(bin_of(a).cast("int").alias("b"), h.bitwiseAND(F.lit(65535)).cast("int").alias("v"))

        return F.transform(heads, tuple_at)

    def spread(s: Column) -> Column:
        fill = lambda x, start: F.array_repeat(x["v"], x["b"] - start + 1)
        body = F.flatten(F.transform(s, lambda x, j: fill(x, F.coalesce(F.get(s, j - 1)["b"] + 1, F.lit(0)))))
        last, first = F.element_at(s, -1), F.get(s, F.lit(0))
        return F.concat(body, F.array_repeat(first["v"], F.lit(BINS - 1) - last["b"]))

    return with_let(sorted_ranks, lambda q: with_let(outer(q), lambda s: F.when(F.size(s) == BINS, F.transform(s, lambda x: x["v"])).otherwise(spread(s))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: BINS values of four hex digits each."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))
    hexed = lambda v: F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
    return with_let(_grams(tokens), lambda g: F.when(F.size(g) == 0, F.lit("0" * (4 * BINS))).otherwise(hexed(_values(_numbered(g)))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values of two fingerprints, 0 to 1."""
    same = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 4 + 1, 4) == F.substring(b, i * 4 + 1, 4))
    return F.size(same) / F.lit(float(BINS))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, text, n, fp, next_part (as many of the next document's first code points as a quarter of n), next_fp.

    The order of ids is found on ids alone. Texts are dealt out by id once, with their fingerprints; from there each document's first
    code points and fingerprint go to its predecessor.
    """
    quarter = lambda n: F.floor(n / F.lit(4)).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    ids = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.max("n").alias("n"), F.min("h").alias("h"))
    # With nulls first, row_no is the place in the order of ids; the predecessor of the first is the last.
    ranked = materialize(global_order(ids, ["doc_id"]), "rank")
    count = ranked.count()
    before = ranked.select(F.expr(f"pmod(row_no + 1, {max(count, 1)})").alias("row_no"), F.struct(F.col("doc_id").alias("id"), F.col("n").alias("n")).alias("pred"))
    to = ranked.join(before, "row_no").select(F.col("doc_id").alias("_id"), "h", F.col("pred")["id"].alias("pred_id"), quarter(F.col("pred")["n"]).alias("send"))
    # Ids as strings, so that a null id joins too. Both uses of the texts need the same three columns, so they are dealt out (and
    # fingerprinted) once and the exchange is used twice.
    dealt = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), "text", fingerprint(F.col("text")).alias("fp"))
    to = to.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_key"), "h", F.coalesce(F.col("pred_id").cast("string"), F.lit("")).alias("_to"), "send")
    # Not an equality of the two sides: the join must stay one on _key alone, or its exchange would be another.
    sent = dealt.join(to, "_key").where(F.xxhash64("text").bitwiseXOR(F.col("h")) == 0).select(F.col("_to").alias("_key"), F.expr("left(text, send)").alias("next_part"), F.col("fp").alias("next_fp"))
    sent = sent.groupBy("_key").agg(F.first("next_part").alias("next_part"), F.first("next_fp").alias("next_fp"))
    out = dealt.join(sent, "_key").withColumn("n", F.length("text"))
    own_id = F.nullif(F.col("_key"), F.lit("")).cast(docs.schema["doc_id"].dataType)
    return out.select(own_id.alias("doc_id"), "text", "n", "fp", F.expr("left(next_part, cast(floor(n / 4) as int))").alias("next_part"), "next_fp")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and how near they and the next document's are."""
    x = with_neighbours(docs)
    edited = F.concat(F.expr("left(text, n - cast(floor(n / 4) as int))"), F.col("next_part"))
    x = x.select("doc_id", F.col("n").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    x = x.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fp")
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))
