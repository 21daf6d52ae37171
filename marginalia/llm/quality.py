"""Quality rules: counted statistics of a text, two fixed base rules, and robust multivariate outliers for what the base rules pass.

Outliers. Four transformed statistics of each text (shrunken log word length, symbols, repeated lines, repeated windows) are
held against a minimum-covariance-determinant estimate of their group, the documents of one language and source. Groups of fewer than
MIN_GROUP documents are held against the estimate of their whole language; languages of fewer, against that of all documents.

The estimate has three deterministic starts: medians and quartile ranges; means and all covariances; and the covariances of statistics pulled in by a
hyperbolic tangent. In a concentration step the HALF share of the group nearest by Mahalanobis distance gives the next mean and covariance. Every start
goes on until its determinant falls no more, with no other end; of each group the start of least determinant counts (of equal ones the first). The covariance is made consistent for the normal case and FLOOR squared is added to its diagonal, because most clean
texts have exactly no symbols and no repeats, so that the raw determinant is zero. A document is rejected if its squared distance
exceeds the chi-square quantile at 1 - TAIL.

All of it is DataFrame work. The documents are counted once, by group and point of a grid of the four statistics; all steps go over these points, one
aggregation by (group, start, bin of distance) each, so a group that holds a third of all rows costs no task more than the others, and a step costs
the same whatever the number of documents. Nearest shares are found from histograms of log distance with BIN steps a unit. Group statistics are one narrow row a group and start; they are broadcast only while
there are at most BROADCAST_GROUPS, and joined plainly beyond.

Edge cases: a null text has no words (base_failed); null languages and sources form groups of their own, apart from the wider groups; repeated rows
count as often as they occur and get one verdict; a table whose texts are all alike rejects none for its distance; an empty table gives no
rows. Columns of the input with the names of results give way to them.
"""

from __future__ import annotations

import math
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import NOT_SPACE, giving_way, in_one_plan, materialize, row_key, set_apart, with_let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept", "_both", "gid", "start", "x_len", "x_sym", "x_line", "x_rep")
STATS = ("x_len", "x_sym", "x_line", "x_rep")
#: Least standard deviation of each transformed statistic.
FLOOR = (0.06, 0.25, 0.5, 0.08)
PRIOR_WORDS, PRIOR_LEN = 50, 5.0
MIN_GROUP, HALF, TAIL, BIN, BROADCAST_GROUPS = 60, 0.5, 1e-6, 200, 20_000
#: Points a partition of the steps' shuffles.
POINTS_A_PARTITION = 10_000
#: Steps of the statistics' grid on which estimates are made: a hundredth or so of the least standard deviations.
GRID = (0.001, 0.005, 0.01, 0.001)
#: A log determinant that a concentration step has not lowered by SETTLED has settled.
SETTLED = 1e-6


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs again; hashes: one a window, in text order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(z: Column) -> Column:
        again = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda j: F.get(z, j - 1)["h"].eqNullSafe(F.get(z, j)["h"]) | F.get(z, j + 1)["h"].eqNullSafe(F.get(z, j)["h"]))
        return F.sort_array(F.transform(again, lambda j: F.get(z, j)["i"]))

    def total(s: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda j: F.least(F.lit(WINDOW), F.get(s, j) - F.get(s, j - 1)))
        return F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)

    return with_let(pairs, lambda z: with_let(starts(z), total))


def repeat_words(ws: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the text, first occurrences included."""
    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        found = with_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(found)

    return with_let(ws, counted)


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of docs but text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.

    Columns of docs with the names of results (or of the statistics derived from them) give way.
    """
    docs = giving_way(docs, *RESULTS)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    ws = words(text)
    both = with_let(ws, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    out = docs.withColumn("_both", both).select(
        *[c for c in docs.columns if c != "text"],
        F.col("_both")["n"].alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        with_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("_both")["r"].alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def transformed() -> dict[str, Column]:
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_len": F.log((chars + PRIOR_WORDS * PRIOR_LEN) / (n + PRIOR_WORDS)),
        "x_sym": F.log1p(100 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        "x_line": F.log1p(F.col("n_dup_lines")),
        "x_rep": F.col("n_repeat_words") / F.greatest(n, F.lit(1)),
    }


def chi2_cdf(x: float, dof: int) -> float:
    """For even dof."""
    term, total = 1.0, 0.0
    for k in range(dof // 2):
        total, term = total + term, term * (x / 2) / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def _joined(df: DataFrame, small: DataFrame, on: str, few: bool) -> DataFrame:
    return df.join(F.broadcast(small) if few else small, on)


def _cholesky(df: DataFrame, factor: float) -> DataFrame:
    """From mean and covariance columns m{i}, c{i}{j} (j <= i) to m{i}, l{i}{j}, with the covariance scaled and floored: one column of the factor at a time."""
    p = len(STATS)

    def rest(i: int, j: int) -> Column:
        x = F.col(f"c{i}{j}") * factor + (FLOOR[i] ** 2 if i == j else 0.0)
        return sum((-F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), x)

    for j in range(p):
        root = F.sqrt(F.greatest(rest(j, j), F.lit(1e-12)))
        df = df.withColumns({f"l{i}{j}": root if i == j else rest(i, j) / root for i in range(j, p)})
    return df


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    y: list[Column] = []
    for i, c in enumerate(STATS):
        y.append(sum((-F.col(f"l{i}{k}") * y[k] for k in range(i)), F.col(c) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((v * v for v in y[1:]), y[0] * y[0]))


def _quantile_bins(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """counts: keys, bin, k. One row for each key: for each share the least bin that holds it cumulatively."""
    w = Window.partitionBy(*keys)
    c = counts.withColumns({"_cum": F.sum("k").over(w.orderBy("bin")), "_all": F.sum("k").over(w)})
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("_cum") >= F.lit(q) * F.col("_all"), F.col("bin"))).alias(name) for name, q in shares.items()])


#: Sums over points of weight k that give means and covariances: s (weights), s{i} (first moments), s{i}{j} (second).
SUMS = ("s", *[f"s{i}" for i in range(len(STATS))], *[f"s{i}{j}" for i in range(len(STATS)) for j in range(i + 1)])


def _sums(prefix: str = "") -> list[Column]:
    x = [F.col(f"{prefix}{c}") for c in STATS]
    k = F.col("k")
    return [F.sum(k).alias("s"), *[F.sum(k * a).alias(f"s{i}") for i, a in enumerate(x)], *[F.sum(k * a * b).alias(f"s{i}{j}") for i, a in enumerate(x) for j, b in enumerate(x[: i + 1])]]


def _moments(df: DataFrame, *keys: str) -> DataFrame:
    """From the sums: keys, means m{i} and (population) covariances c{i}{j}."""
    p = range(len(STATS))
    df = df.withColumns({f"m{i}": F.col(f"s{i}") / F.col("s") for i in p})
    return df.select(*keys, *[f"m{i}" for i in p], *[(F.col(f"s{i}{j}") / F.col("s") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i in p for j in range(i + 1)])


def _log_det() -> Column:
    return sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, len(STATS))), 2 * F.log(F.col("l00")))


def _starts(x: DataFrame) -> DataFrame:
    """x: gid, STATS, k. gid, start, m{i} and c{i}{j} of the three starts of each group."""
    p = range(len(STATS))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    stacked = x.select("gid", "k", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.round(F.col(c) * 1000).cast("long").alias("bin")) for i, c in enumerate(STATS)])).alias("s"))
    counts = stacked.groupBy("gid", "s.f", "s.bin").agg(F.sum("k").alias("k"))
    q = _quantile_bins(counts, ["gid", "f"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    middle = q.groupBy("gid").agg(*[F.max(F.when(F.col("f") == i, F.col("q2"))).alias(f"q{i}") for i in p], *[F.max(F.when(F.col("f") == i, F.col("q3") - F.col("q1"))).alias(f"w{i}") for i in p])
    middle = materialize(middle.select("gid", *[(F.col(f"q{i}") / 1000).alias(f"q{i}") for i in p], *[(F.col(f"w{i}") / 1349.0).alias(f"w{i}") for i in p]), "middle")
    first = middle.select("gid", F.lit(0).alias("start"), *[F.col(f"q{i}").alias(f"m{i}") for i in p], *[(F.pow(F.col(f"w{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs])
    second = _moments(x.groupBy("gid").agg(*_sums()), "gid").withColumn("start", F.lit(1))
    scale = [F.greatest(F.col(f"w{i}"), F.lit(FLOOR[i])) for i in p]
    pulled = _joined(x, middle, "gid", middle.count() <= BROADCAST_GROUPS)
    pulled = pulled.select("gid", "k", *[F.col(f"q{i}") for i in p], *[F.col(f"w{i}") for i in p], *[F.tanh((F.col(c) - F.col(f"q{i}")) / scale[i]).alias(f"t_{c}") for i, c in enumerate(STATS)])
    third = _moments(pulled.groupBy("gid", *[f"q{i}" for i in p], *[f"w{i}" for i in p]).agg(*_sums("t_")), "gid", *[f"q{i}" for i in p], *[f"w{i}" for i in p])
    third = third.select("gid", F.lit(2).alias("start"), *[F.col(f"q{i}").alias(f"m{i}") for i in p], *[(F.col(f"c{i}{j}") * scale[i] * scale[j]).alias(f"c{i}{j}") for i, j in pairs])
    return first.unionByName(second).unionByName(third)


def _step(x: DataFrame, fit: DataFrame, few: bool, factor: float) -> DataFrame:
    """One concentration step of every (gid, start) of fit: one pass over the points.

    Points are summed up by bins of their distance; the nearest bins that hold HALF of a group together are summed up again.
    """
    far = _distance(_joined(x, fit, "gid", few)).withColumn("bin", F.floor(F.log1p("d2") * BIN).cast("long"))
    # A group's earlier fit is the same in all its points and goes along.
    bins = far.groupBy("gid", "start", "bin").agg(*_sums(), *[F.max(c).alias(f"was_{c}") for c in FIT])
    own = Window.partitionBy("gid", "start")
    bins = bins.withColumns({"_before": F.sum("s").over(own.orderBy("bin")) - F.col("s"), "_all": F.sum("s").over(own)})
    near = bins.where(F.col("_before") < F.lit(HALF) * F.col("_all")).groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in WAS])
    return _cholesky(_moments(near, "gid", "start", *WAS), factor).withColumn("log_det", _log_det()).select("gid", "start", *FIT, *WAS)


FIT = (*[f"m{i}" for i in range(len(STATS))], *[f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)], "log_det")
WAS = tuple(f"was_{c}" for c in FIT)


def robust_fit(x: DataFrame) -> tuple[DataFrame, bool]:
    """x: gid and STATS. (one row for each gid with m{i}, l{i}{j}, log_det and start; whether there are few groups)."""
    x = materialize(points(x), "points")
    spark, dealt = x.sparkSession, x.count() // POINTS_A_PARTITION + 1
    cut = chi2_quantile(HALF, len(STATS))
    factor = HALF / chi2_cdf(cut, len(STATS) + 2)
    few = x.select("gid").distinct().count() <= BROADCAST_GROUPS // 3
    # Many groups are joined plainly, and adaptively.
    with in_one_plan(spark, dealt) if few else nullcontext():
        return _settled(x, few, factor), few


def _settled(x: DataFrame, few: bool, factor: float) -> DataFrame:
    """x: points. Of each gid the fit of least determinant that the steps from its starts end at."""
    fit = materialize(_cholesky(_starts(x), 1.0).select("gid", "start", *FIT[:-1], F.lit(None).cast("double").alias("log_det")), "mcd")
    done = None
    while True:
        # One step a table: plans stay small. The starts have no determinant of their own to be held against.
        less = F.col("was_log_det").isNull() | (F.col("log_det") < F.col("was_log_det") - SETTLED)
        new = _step(x, fit, few, factor).withColumn("settled", ~less)
        new = materialize(new.select("gid", "start", "settled", *[F.when(F.col("settled"), F.col(f"was_{c}")).otherwise(F.col(c)).alias(c) for c in FIT]), "mcd")
        ended = new.where("settled").drop("settled")
        done = ended if done is None else done.unionByName(ended)
        fit = new.where("not settled").drop("settled")
        if fit.isEmpty():
            break
    best = done.groupBy("gid").agg(F.min_by(F.struct("start", *FIT), F.struct(F.round("log_det", 9), "start")).alias("b")).select("gid", "b.*")
    return materialize(best, "mcd")


def points(x: DataFrame) -> DataFrame:
    """gid, STATS (rounded to GRID) and k, the documents there: what the estimates are made of. Its size is bounded by the grid, not by the documents."""
    rounded = [(F.round(F.col(c) / g) * g).alias(c) for c, g in zip(STATS, GRID)]
    return x.select("gid", *rounded).groupBy("gid", *STATS).agg(F.count(F.lit(1)).cast("double").alias("k"))


def _group_of(level: str, *names: str) -> Column:
    """The name of a group at a level; nulls are names too."""
    return F.concat(F.lit(level + ":"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit(""))


def judge(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang, source and any others. Its columns but text, the statistics, d2 (null if base_failed) and kept."""
    docs = giving_way(docs, *RESULTS)
    keep = [c for c in docs.columns if c != "text"]
    base = materialize(statistics(docs).withColumns(transformed()), "quality")
    fits = base.where(~F.col("base_failed"))
    sizes = materialize(fits.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    own, language, every = _group_of("source", "lang", "source"), _group_of("language", "lang"), _group_of("all")
    spoken = sizes.groupBy("lang").agg(F.sum("_n").alias("_of_lang"), F.min("_n").alias("_least")).withColumnRenamed("lang", "_k")
    rarest = spoken.agg(F.min("_of_lang")).first()[0]
    groups = sizes.join(spoken, F.col("lang").eqNullSafe(F.col("_k"))).withColumn("_wide", F.lit(rarest is not None and rarest < MIN_GROUP))
    # gid: what a document is held against; member: the groups whose estimates it is counted in.
    gid = F.when(F.col("_n") >= MIN_GROUP, own).when(F.col("_of_lang") >= MIN_GROUP, language).otherwise(every)
    member = F.array_compact(F.array(F.when(F.col("_n") >= MIN_GROUP, own), F.when((F.col("_least") < MIN_GROUP) & (F.col("_of_lang") >= MIN_GROUP), language), F.when(F.col("_wide"), every)))
    groups = materialize(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), gid.alias("gid"), member.alias("_member")), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    side = F.broadcast(groups) if few else groups
    keyed = base.join(side, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    x = keyed.where(~F.col("base_failed")).select(F.explode("_member").alias("gid"), *STATS)
    fit, few_fits = robust_fit(x)
    scored = _distance(keyed.join(F.broadcast(fit) if few_fits else fit, "gid", "left"))
    limit = chi2_quantile(1 - TAIL, len(STATS))
    kept = ~F.col("base_failed") & (F.col("d2") <= limit)
    return scored.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), F.coalesce(kept, F.lit(False)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source and any others) that judge() keeps; the few rejected ones are taken out by an anti-join."""
    names, docs = docs.columns, set_apart(docs, "doc_id", "text", "lang", "source")
    keyed = docs.withColumn("_row", row_key(docs))
    rejected = judge(keyed.select("_row", "text", "lang", "source")).where(~F.col("kept")).select("_row").distinct()
    return keyed.join(rejected, "_row", "left_anti").drop("_row").toDF(*names)
