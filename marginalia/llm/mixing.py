"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree, filled from seeded epochs.

Budgets. The token budget is shared out from the root: among the domains, then within each domain among its languages, then within each language
among its sources, in proportion to the nodes' weights, but to no node more than its capacity (its tokens times MOST_EPOCHS,
a node's capacity being the sum of its leaves'). What a node cannot take is shared among its siblings by their weights; only what all
siblings together cannot take is missed one level up, where capacities have already been counted, so it goes to the parent's siblings first of all.
Each step is one water level for each family of siblings, found by running sums in the order of capacity over weight.

Selection. A leaf with budget b and T tokens is read floor(b / T) whole epochs, and then the prefix of one more epoch, in that epoch's own
seeded order (MD5 of seed, epoch and id), up to the first document that would exceed the rest. Running sums over a leaf
are taken in two steps: the order is cut into buckets of about BUCKET_ROWS documents, sums of buckets give the one bucket in which the prefix ends, and only that
bucket's documents are summed one by one. So a leaf that holds a third of all documents needs no task of its own.

Texts never move: the leaf table is broadcast while it has at most BROADCAST_LEAVES rows, and joined plainly beyond; only
the boundary buckets are dealt out.

Edge cases: null languages, sources and domains are nodes of their own; a null text has no tokens (it comes with every epoch that is
read whole, and in the last one if its place is within the prefix); a leaf without tokens, or of weight 0, gets nothing; if the budget exceeds the
root's capacity every leaf is read MOST_EPOCHS times; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import NOT_SPACE, giving_way, materialize

LEVELS = ("domain", "lang", "source")
#: Weights of nodes by the names on their path; others have weight 1.
WEIGHTS = {
    ("reference",): 3.0, ("news",): 2.0, ("forum",): 1.0, ("web",): 2.0,
    ("*", "en"): 4.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 2.0,
}
#: The domain of a source is that of its number modulo four.
DOMAINS = ("web", "news", "reference", "forum")
BUDGET_SHARE, MOST_EPOCHS, SEED = 0.6, 4, 7
BUCKET_ROWS, BROADCAST_LEAVES = 2048, 50_000


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1)


def tokens_of(text: Column) -> Column:
    """Tokens are words here; any count will do."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def _weight(depth: int, weights: dict) -> Column:
    """The weight of a node at a depth (1: domain); a path with a * fits any name there, and a full path goes first."""
    out = F.lit(1.0)
    for path, w in sorted(((p, w) for p, w in weights.items() if len(p) == depth), key=lambda x: -x[0].count("*")):
        fits = F.lit(True)
        for name, level in zip(path, LEVELS):
            if name != "*":
                fits = fits & F.col(level).eqNullSafe(F.lit(name))
        out = F.when(fits, F.lit(float(w))).otherwise(out)
    return out


def _share(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """nodes: w, cap and budget (the family's). Adds got: each node's share of its family's budget."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = [F.col("cap") / F.nullif(F.col("w"), F.lit(0.0)), F.col(name)]
    live = F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0)
    before = F.coalesce(F.sum(live).over(w.orderBy(*[F.asc_nulls_last(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(w.orderBy(*[F.asc_nulls_last(o) for o in order]).rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("_level", (F.col("budget") - before) / F.nullif(rest, F.lit(0.0)))
    nodes = nodes.withColumn("_full", F.col("cap") < F.col("_level") * F.col("w"))
    water = F.max(F.when(~F.col("_full"), F.col("_level"))).over(w)
    got = F.when(F.col("w") <= 0, 0.0).when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), water * F.col("w")))
    return nodes.withColumn("got", F.greatest(F.lit(0.0), got)).drop("_level", "_full")


def leaf_budgets(leaves: DataFrame, budget: float, weights: dict = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """leaves: LEVELS and tokens. LEVELS, tokens and budget (long) of each leaf."""
    cap = (F.col("tokens") * epochs).cast("double")
    nodes = leaves.select(*LEVELS, "tokens", cap.alias("leaf_cap"))
    top = F.lit(float(budget))
    families: list[str] = []
    parents = None
    for depth, level in enumerate(LEVELS, 1):
        own = nodes.groupBy(*LEVELS[:depth]).agg(F.sum("leaf_cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(depth, weights))
        if parents is None:
            own = own.withColumn("budget", top)
        else:
            match = [own[f].eqNullSafe(parents[f"p_{f}"]) for f in families]
            cond = match[0]
            for m in match[1:]:
                cond = cond & m
            own = own.join(parents, cond).drop(*[f"p_{f}" for f in families])
        got = _share(own, families, level)
        families.append(level)
        parents = got.select(*[F.col(f).alias(f"p_{f}") for f in families], F.col("got").alias("budget"))
    return got.select(*LEVELS, "tokens", F.floor(F.col("got") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, budget: float | None = None, weights: dict = WEIGHTS, epochs: int = MOST_EPOCHS, seed: int = SEED, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs: doc_id, text, lang, source and any others. All of them with domain, n_tokens and epoch: a row for each epoch in which a document is selected.

    budget: tokens; None: BUDGET_SHARE of all. Columns of docs named n_tokens or epoch give way to the results; one named domain does unless it is
    passed as the domain.
    """
    docs = giving_way(docs, "n_tokens", "epoch", *(["domain"] if domain is None else []))
    own = [c for c in docs.columns if c.lower() != "domain"]
    work = docs.select(F.struct(*own).alias("row"), (domain_of(F.col("source")) if domain is None else domain).alias("domain"), "lang", "source", F.col("doc_id").cast("string").alias("_id"), (tokens_of(F.col("text")) if tokens is None else tokens).alias("n_tokens"))
    leaves = materialize(work.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
    total = leaves.agg(F.sum("tokens"), F.sum("n"), F.count(F.lit(1))).first()
    few = total[2] <= BROADCAST_LEAVES
    side = lambda t: F.broadcast(t) if few else t
    goal = float(BUDGET_SHARE * (total[0] or 0) if budget is None else budget)
    plan = leaf_budgets(leaves, goal, weights, epochs)
    plan = plan.where("tokens > 0 and budget > 0").select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"), "budget")
    plan = materialize(plan, "plan")
    leaf = [f"p_{c}" for c in LEVELS]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(side(right), F.col("domain").eqNullSafe(F.col("p_domain")) & F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source")))

    buckets = max(1, (total[1] or 0) // BUCKET_ROWS)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce("_id", F.lit(""))).cast("binary"))
    cut = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * buckets).cast("long")
    drawn = lambda right: joined(work, right).withColumn("_order", order).withColumn("_bucket", cut)
    sums = drawn(plan).groupBy(*leaf, "_bucket", "rest").agg(F.sum("n_tokens").alias("_t"))
    upto = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_end", F.sum("_t").over(upto))
    ends = sums.where(F.col("_end") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("_bucket", (F.col("rest") - F.col("_end") + F.col("_t")).alias("room"))).alias("edge"))
    ends = ends.select(*[F.col(c).alias(f"e{c}") for c in leaf], "edge.*")
    cond = F.lit(True)
    for c in leaf:
        cond = cond & F.col(c).eqNullSafe(F.col(f"e{c}"))
    full = materialize(plan.join(ends, cond, "left").select(*leaf, "whole", "budget", F.col("_bucket").alias("_last"), "room"), "edges")
    rows = drawn(full)
    inside = F.col("_last").isNull() | (F.col("_bucket") < F.col("_last"))
    away = rows.where(~F.col("_bucket").eqNullSafe(F.col("_last"))).withColumn("_in", inside)
    run = Window.partitionBy(*LEVELS).orderBy("_order", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.where(F.col("_bucket").eqNullSafe(F.col("_last"))).withColumn("_in", F.sum("n_tokens").over(run) <= F.col("room"))
    # The prefix ends at the first document that exceeds it; sums only grow, so no later one is within it.
    both = away.unionByName(near).withColumn("_copies", F.col("whole") + F.when(F.col("_in"), 1).otherwise(0)).where("_copies > 0")
    return both.select("row.*", F.col("domain").alias("domain"), F.col("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch"))


def _weight_sql(depth: int, weights: dict) -> str:
    paths = sorted(((p, w) for p, w in weights.items() if len(p) == depth), key=lambda x: x[0].count("*"))
    cases = " ".join(f"WHEN {' AND '.join([f'{c} = {n!r}' for n, c in zip(p, LEVELS) if n != '*'] or ['true'])} THEN {w}" for p, w in paths)
    return f"CASE {cases} ELSE 1.0 END::DOUBLE" if cases else "1.0::DOUBLE"


def oracle(weights: dict = WEIGHTS, share: float = BUDGET_SHARE, epochs: int = MOST_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for doc_id, domain, lang, source, n_tokens, epoch."""
    steps, keys = [], []
    for depth, level in enumerate(LEVELS, 1):
        of = ", ".join(LEVELS[:depth])
        family = ", ".join(keys) or "1"
        budget = f"(SELECT {share} * sum(tokens) FROM leaves)" if depth == 1 else "p.got"
        source = f"(SELECT {of}, sum(tokens * {epochs})::DOUBLE cap, {_weight_sql(depth, weights)} w FROM leaves GROUP BY {of}) n"
        join = "" if depth == 1 else f" JOIN s{depth - 1} p ON " + " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
        cols = ", ".join(f"n.{k}" for k in LEVELS[:depth])
        order = f"PARTITION BY {family} ORDER BY cap / nullif(w, 0) NULLS LAST, {level} NULLS LAST"
        steps.append(f"b{depth} AS (SELECT {cols}, cap, w, {budget}::DOUBLE budget FROM {source}{join})")
        steps.append(
            f"l{depth} AS (SELECT *, (budget - coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) lev FROM b{depth})"
        )
        steps.append(f"s{depth} AS (SELECT {of}, greatest(0, CASE WHEN w <= 0 THEN 0 WHEN cap < lev * w THEN cap ELSE least(cap, w * max(CASE WHEN cap < lev * w THEN NULL ELSE lev END) OVER (PARTITION BY {family})) END) got FROM l{depth})")
        keys.append(level)
    match = " AND ".join(f"d.{k} IS NOT DISTINCT FROM p.{k}" for k in LEVELS)
    names = ", ".join(map(repr, DOMAINS))
    return f"""
WITH d AS (SELECT doc_id, lang, source, list_extract([{names}], coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % {len(DOMAINS)} + 1) AS "domain",
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT n_tokens FROM documents),
leaves AS (SELECT {', '.join(LEVELS)}, sum(n_tokens) tokens FROM d GROUP BY {', '.join(LEVELS)}),
{', '.join(steps)},
p AS (SELECT s3.*, tokens, floor(got + 1e-6)::BIGINT budget FROM s3 JOIN leaves l ON {' AND '.join(f's3.{k} IS NOT DISTINCT FROM l.{k}' for k in LEVELS)}),
r AS (SELECT d.*, (budget // tokens)::INT whole, budget % tokens AS rest,
  sum(n_tokens) OVER (PARTITION BY d."domain", d.lang, d.source ORDER BY md5('{seed}:' || (budget // tokens)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) upto
  FROM d JOIN p ON {match} WHERE tokens > 0 AND budget > 0),
c AS (SELECT *, whole + (CASE WHEN upto <= rest THEN 1 ELSE 0 END) copies FROM r)
SELECT doc_id, "domain", lang, source, n_tokens, unnest(range(copies))::INT AS epoch FROM c WHERE copies > 0
"""
