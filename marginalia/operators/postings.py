"""Inverted index of the lines of notes, and the lines of a batch of queries that can score at all.

The index, four tables:
  lines     note, line, content: every line once
  postings  word, note, line, before, after: every place of every word, with its neighbours in the line; filed in folders by the word's hash
  words     word, lines: how many places a word has
  grams     gram, word, lines: each run of three characters of a word, in order, to find the words that contain a query's token

Search. A line matters only if one of its five scores reaches LEAST. Each score then needs words of the query to be there, which is a join of
words with postings, not a scan of texts:
  text, keyword   LEAST of the (distinct) tokens, as words. The most frequent tokens, up to a quarter of the query, are not looked up: a line must
                  have what is then still missing of the others.
  ordered         all of the first LEAST tokens, inside words. The two rarest of these are looked up, and a line must have both.
  phrase          two consecutive tokens, the one ending a word and the next beginning the word after it: places of the rarer one whose neighbour
                  fits. (Consecutive positions are joined once, when the index is built.) A phrase of one token: places of it inside words.
  literal         the longest run of word characters of one of the terms, inside a word; terms without such a run are searched in the lines.
These are necessary conditions: what they let through is scored in full by functions.scores, so results are those of a scan of all lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.functions.columns import bound, let
from marginalia.sources.scratch import kept, new_path, spread

#: The least score of a line that matters, in hundredths: the lower of the gates of the text channel.
LEAST = 55
#: At most this share of a query's tokens, in hundredths, is left out of the look-up.
LEFT_OUT = 25
FOLDERS, SALTS = 32, 4
RUN = "[a-z0-9']+"


def _folder(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FOLDERS)).cast("int")


@dataclass
class Postings:
    spark: SparkSession
    path: str

    @property
    def lines(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lines")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    @property
    def words(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/words")


def line_rows(notes: DataFrame) -> DataFrame:
    """rel_path, line (from 0), content."""
    return notes.select("rel_path", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("line", "content"))


def build(notes: DataFrame, path: str | None = None) -> Postings:
    """notes: rel_path, text."""
    spark = notes.sparkSession
    path = path or new_path(spark, "postings")
    line_rows(spread(notes.select("rel_path", "text"))).write.parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")

    def places(words: Column, own: Column) -> Column:
        """Each word of the normalized line with its neighbours, and tokens that are no such word (letters that lower-casing turns into others)."""
        at = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get(words, i - 1)).alias("before"), F.get(words, i + 1).alias("after")))
        none = F.lit(None).cast("string")
        rest = F.transform(F.array_except(own, words), lambda w: F.struct(w.alias("word"), none.alias("before"), none.alias("after")))
        return F.concat(at, rest)

    norm = F.regexp_extract_all(T.normalize(F.col("content")), F.lit(RUN), F.lit(0))
    found = let(norm, lambda w: places(w, T.tokens(F.col("content"))))
    rows = lines.select(F.explode(found).alias("p"), "rel_path", "line").select("p.*", "rel_path", "line")
    filed = rows.withColumn("folder", _folder(F.col("word")))
    # A frequent word makes its folder large: each folder is dealt out to SALTS tasks.
    filed.repartition(FOLDERS * SALTS, "folder", F.pmod(F.xxhash64("rel_path"), F.lit(SALTS))).sortWithinPartitions("folder", "word").write.partitionBy("folder").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("word").agg(F.count(F.lit(1)).alias("lines"))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring(F.col("word"), i, F.lit(3)))
    grams = F.when(F.length("word") >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
    counts.write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    words.select("word", "lines", F.explode(grams).alias("gram")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return Postings(spark, path)


def _holding(index: Postings, tokens: DataFrame) -> DataFrame:
    """tokens: token. token, word, lines for the words that contain it: those that have its first three characters in a row are compared."""
    asked = tokens.select("token", F.substring("token", 1, 3).alias("gram")).distinct()
    return index.grams.join(asked, "gram").where(F.contains("word", "token")).select("token", "word", "lines")


def needles(index: Postings, queries: DataFrame) -> DataFrame:
    """queries: query_id, q (features). What is looked up of each query.

    query_id, word, weight and distinct (of text and keyword; else 0), bit (of ordered; else 0), sure (a place of it makes the line a candidate), after and
    before (what the neighbour must begin or end with, or null), need and need_distinct (of the whole query: weight and tokens in a line).
    """
    q = F.col("q")
    toks = queries.select("query_id", q["toks"].alias("toks"), q["terms"].alias("terms"), F.size(q["toks"]).alias("n"))
    one = toks.select("query_id", "n", F.posexplode("toks").alias("i", "token"))
    runs = F.transform("terms", lambda t: F.array_max(F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda r: F.struct(F.length(r).alias("k"), r.alias("r")))))
    run = toks.select("query_id", F.explode(F.filter(runs, lambda r: r["k"] >= 3)).alias("r")).select("query_id", F.col("r.r").alias("token")).distinct()
    # Words that contain a token, and how many lines those are in (counted by place, which is enough to order tokens).
    holding = kept(_holding(index, one.select("token").union(run.select("token")).distinct()), "holding")
    inside = holding.groupBy("token").agg(F.sum("lines").alias("inside"))
    as_word = index.words.select(F.col("word").alias("token"), F.col("lines").alias("own"))
    known = kept(one.join(inside, "token", "left").join(as_word, "token", "left").na.fill(0, ["inside", "own"]), "tokens")

    # Text and keyword: all distinct tokens but the most frequent.
    mine = known.groupBy("query_id", "n", "token", "own").agg(F.count(F.lit(1)).alias("weight"))
    per = mine.groupBy("query_id", "n").agg(F.sort_array(F.collect_list(F.struct("own", "token", "weight")), asc=False).alias("by"))
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("k"))

    def leave(acc: Column, t: Column) -> Column:
        w, k = acc["w"] + t["weight"], acc["k"] + 1
        # Frequent ones come first; the first that does not fit ends it, as no later k can follow.
        fits = (100 * w <= LEFT_OUT * F.col("n")) & (100 * k <= LEFT_OUT * F.size("by"))
        return F.when(fits, F.struct(w.alias("w"), k.alias("k"))).otherwise(acc)

    # A token is left out in order of frequency; tokens after one that does not fit may still fit, so left-out ones are marked one by one.
    marked = F.aggregate(
        "by", F.struct(start["w"].alias("w"), start["k"].alias("k"), F.array().cast("array<string>").alias("out")),
        lambda acc, t: let(leave(F.struct(acc["w"].alias("w"), acc["k"].alias("k")), t), lambda a: F.struct(a["w"].alias("w"), a["k"].alias("k"), F.when(a["k"] > acc["k"], F.concat(acc["out"], F.array(t["token"]))).otherwise(acc["out"]).alias("out"))),
    )
    per = per.withColumn("m", marked)
    per = per.select("query_id", "by", F.col("m.out").alias("out"), (F.lit(LEAST) * F.col("n") - 100 * F.col("m.w") - 1).alias("need"), (F.lit(LEAST) * F.size("by") - 100 * F.col("m.k") - 1).alias("need_distinct"))
    zero, false, none = F.lit(0), F.lit(False), F.lit(None).cast("string")
    shape = ["query_id", "word", "weight", "distinct", "bit", "sure", "before", "after"]

    def row(df: DataFrame, word, **given) -> DataFrame:
        default = {"weight": zero.cast("long"), "distinct": zero, "bit": zero, "sure": false, "before": none, "after": none} | given
        return df.select("query_id", word.alias("word"), *[v.alias(k) for k, v in default.items()]).select(*shape)

    exact = per.select("query_id", F.explode(F.filter("by", lambda t: ~F.array_contains("out", t["token"]))).alias("t"), "out")
    exact = row(exact, F.col("t.token"), weight=F.col("t.weight"), distinct=F.lit(1))

    # Ordered: the two rarest distinct tokens of the first LEAST hundredths.
    lead = known.where(F.col("i") < F.ceil(F.col("n") * LEAST / F.lit(100)))
    lead = lead.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("inside", "token"))), 1, 2).alias("t"))
    lead = lead.select("query_id", F.posexplode("t").alias("i", "t"), F.size("t").alias("k"))
    lead = lead.select("query_id", F.col("t.token").alias("token"), F.when(F.col("k") == 1, 3).otherwise(F.col("i") + 1).alias("bit")).join(holding, "token")
    lead = row(lead, F.col("word"), bit=F.col("bit"))

    # Phrase: consecutive tokens, by the rarer one.
    two = known.alias("a").join(known.alias("b"), (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.i") + 1 == F.col("b.i")))
    two = two.select(F.col("a.query_id").alias("query_id"), F.col("a.token").alias("one"), F.col("b.token").alias("two"), (F.col("a.inside") <= F.col("b.inside")).alias("first")).distinct()
    first = two.where("first").join(holding.withColumnRenamed("token", "one"), "one").where(F.endswith("word", "one"))
    second = two.where("not first").join(holding.withColumnRenamed("token", "two"), "two").where(F.startswith("word", "two"))
    pairs = row(first, F.col("word"), sure=F.lit(True), after=F.col("two")).union(row(second, F.col("word"), sure=F.lit(True), before=F.col("one")))
    # Phrases of one token, and terms: any word that holds them.
    single = known.where("n = 1").select("query_id", "token").union(run.select("query_id", "token")).distinct().join(holding, "token")
    every = exact.union(lead).union(pairs).union(row(single, F.col("word"), sure=F.lit(True)))
    return every.join(per.select("query_id", "need", "need_distinct"), "query_id", "left").distinct()


def candidate_lines(index: Postings, queries: DataFrame) -> DataFrame:
    """query_id, rel_path, line of every line that may reach LEAST (and some that do not)."""
    asked = needles(index, queries).withColumn("folder", _folder(F.col("word")))
    met = index.postings.alias("p").join(asked.alias("n"), ["folder", "word"])
    fits = (F.col("n.after").isNull() | F.startswith("p.after", "n.after")) & (F.col("n.before").isNull() | F.endswith("p.before", "n.before"))
    # One row a place: words that stand twice in a line are counted once, in two steps, so that partial sums stay small.
    once = met.where(fits).groupBy("query_id", "rel_path", "line", "word").agg(
        F.max("weight").alias("weight"), F.max("distinct").alias("distinct"), F.bit_or("bit").alias("bit"), F.max("sure").alias("sure"), F.max("need").alias("need"), F.max("need_distinct").alias("need_distinct")
    )
    found = once.groupBy("query_id", "rel_path", "line").agg(
        F.sum("weight").alias("weight"), F.sum("distinct").alias("distinct"), F.bit_or("bit").alias("bit"), F.max("sure").alias("sure"), F.max("need").alias("need"), F.max("need_distinct").alias("need_distinct")
    )
    enough = F.col("sure") | (F.col("bit") == 3) | ((F.col("weight") > 0) & ((100 * F.col("weight") >= F.col("need")) | (100 * F.col("distinct") >= F.col("need_distinct"))))
    out = found.where(enough).select("query_id", "rel_path", "line")
    # Terms without a run of three word characters have no words to look up.
    bare = F.filter(F.col("q")["terms"], lambda t: ~F.exists(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= 3))
    odd = queries.select("query_id", F.explode(bare).alias("term"))
    if odd.isEmpty():
        return out
    scanned = index.lines.join(odd, F.contains(F.lower("content"), F.col("term"))).select("query_id", "rel_path", "line")
    return out.union(scanned).distinct()


def best_lines(index: Postings, queries: DataFrame) -> DataFrame:
    """The best line of each note that has one of at least LEAST: as operators.search.best_lines, for those notes."""
    return best_of(candidate_lines(index, queries).join(index.lines, ["rel_path", "line"]), queries)


def best_of(found: DataFrame, queries: DataFrame) -> DataFrame:
    """found: query_id, rel_path, line, content; d and quality if they are known. The best of these lines of each query and note."""
    rows = found if "d" in found.columns else bound(found, d=S.text_features(F.col("content")))
    return S.best_of_lines(rows.join(queries.select("query_id", "q"), "query_id"))
