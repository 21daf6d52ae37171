"""URL filters: literal allow and block rules, and an empirical-Bayes reputation of hosts for urls that no rule fits.

Reputation. Labelled outcomes of pages (good or not) are counted for each host. Hosts roll up into registered domains, these
into suffixes, these into all. At each level the counts of a unit are shrunk towards its parent's posterior mean m by a
beta prior Beta(k m, k (1 - m)); the strength k of a level is estimated by the method of moments from how far its units scatter
around their parents beyond binomial noise (few units or no excess scatter: a strong prior). A host's posterior is thus
Beta(k m + good, k (1 - m) + bad). A host is blocked if the upper posterior bound of its share of good pages, mean + z sd of
the beta distribution, lies under the least share asked for; a host with no outcome takes its domain's posterior mean with the
prior's own spread, so it is blocked only on strong evidence about its relatives.

Everything is DataFrame work: outcomes are counted by host before anything else, the three upper levels are computed from
host counts, and only the host table is joined to the pages (a plain join; adaptive execution splits a host that holds many pages).

Edge cases: a null url, or one without "://", has an empty host and path; the empty host is a host like any other. Repeated
pages count as often as they occur. With no outcomes at all every host is allowed; a table without pages gives no row. Ports and users are no part of a
host's domain, and a numeric host is a domain of its own. Columns other than page_id and url are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize

#: Host, path prefix, verdict: the rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels under which domains are registered (fixed values, of the public suffix list); any other suffix is the last label.
TWO_LABEL_SUFFIXES = (
    "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "net.au", "net.br", "net.cn", "ne.jp", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.nz", "org.uk", "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app",
)
#: What a host has before and after its name: a user, a port. And names that are numbers, each a domain and a suffix of its own.
AROUND_NAME, NUMERIC = "^.*@|:[0-9]*$", r"^([0-9]+([.][0-9]+){3}|\[.*\])$"
LEAST_GOOD, Z = 0.5, 1.645
#: Digits of the posterior in results: sums of another order differ beyond them.
DIGITS = 6
#: Bounds of a level's prior strength, in pages.
WEAK, STRONG = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    name = F.regexp_replace(host, AROUND_NAME, "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(NUMERIC), name).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; the host's name itself if it has no more or is a number."""
    name = F.regexp_replace(host, AROUND_NAME, "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(NUMERIC), name).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits host and path; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame, by: str, n: str, good: str, mean: str) -> DataFrame:
    """One row: the prior strength of the units around their parents' means, by moments of the weighted scatter."""
    m, k = F.col(mean), F.col(n)
    sums = units.where(k > 0).agg(
        F.count(F.lit(1)).alias("u"),
        F.sum(k * F.pow(F.col(good) / k - m, 2)).alias("scatter"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum(k * m * (1 - m)).alias("whole"),
    )
    # E scatter = noise + rho (whole - noise), rho = 1 / (strength + 1)
    rho = (F.col("scatter") - F.col("noise")) / F.nullif(F.col("whole") - F.col("noise"), F.lit(0.0))
    k_hat = F.when((F.col("u") < 3) | rho.isNull() | (rho <= 0), F.lit(STRONG)).otherwise(F.greatest(F.lit(WEAK), F.least(F.lit(STRONG), 1 / F.greatest(rho, F.lit(1e-9)) - 1)))
    return sums.select(k_hat.alias(by))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, good (boolean; null: not labelled). One row for each host: host, n_labelled, n_good, prior_mean, strength, post_mean, post_sd."""
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("g"))
    # Written once: each level and each strength reads it, and none of them the pages.
    hosts = materialize(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "g"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("g").alias("dg"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dg").alias("sg"))
    top = suffixes.agg(((F.coalesce(F.sum("sg"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 1)).alias("m0"))
    # The one-row tables below are joined without keys: each is a single aggregate row.
    s = suffixes.join(F.broadcast(top))
    s = s.join(F.broadcast(_strength(s, "k_s", "sn", "sg", "m0")))
    s = s.select("suffix", ((F.col("k_s") * F.col("m0") + F.col("sg")) / (F.col("k_s") + F.col("sn"))).alias("m_s"))
    d = domains.join(s, "suffix")
    d = d.join(F.broadcast(_strength(d, "k_d", "dn", "dg", "m_s")))
    d = d.select("domain", "suffix", ((F.col("k_d") * F.col("m_s") + F.col("dg")) / (F.col("k_d") + F.col("dn"))).alias("m_d"))
    h = hosts.join(d, ["domain", "suffix"])
    h = h.join(F.broadcast(_strength(h, "k_h", "n", "g", "m_d")))
    a, b = F.col("k_h") * F.col("m_d") + F.col("g"), F.col("k_h") * (1 - F.col("m_d")) + F.col("n") - F.col("g")
    return h.select(
        "host", F.col("n").alias("n_labelled"), F.col("g").alias("n_good"), F.col("m_d").alias("prior_mean"), F.col("k_h").alias("strength"),
        (a / (a + b)).alias("post_mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("post_sd"),
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_good: float = LEAST_GOOD, z: float = Z) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, good. One row for each page with host, path, rule, verdict and the host's posterior."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "_v": verdict})
    rep = host_reputation(parsed.join(outcomes.select("page_id", "good"), "page_id", "left"))
    rep = rep.withColumn("upper_good", F.least(F.lit(1.0), F.col("post_mean") + F.lit(z) * F.col("post_sd")))
    out = parsed.join(rep, "host", "left")
    own = F.when(F.col("upper_good") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_v", own).alias("verdict"), "n_labelled", "n_good", "post_mean", "post_sd", "upper_good")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, good: the outcome of the document whose id ends a page's path; good: of good quality and not toxic.

    Where a document is labelled more than once, it is good if every label says so. Pages with no label have no row.
    """
    doc = F.nullif(F.regexp_extract(F.col("url"), r"(?s)^.*?://[^/?#]*/[^/?#]*/([0-9]{1,18})(?:[.]html?)?(?:[/?#]|$)", 1), F.lit("")).cast("long")
    said = labels.groupBy("doc_id").agg(F.min((F.coalesce(F.col("quality"), F.lit(1)) >= 1) & (F.coalesce(F.col("toxic"), F.lit(0)) <= 0)).alias("good"))
    keyed = pages.select("page_id", doc.alias("doc_id")).where("doc_id is not null").distinct()
    return keyed.join(said, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))


def _labels_sql(host: str, more: int) -> str:
    """The suffix of a host, and `more` labels before it."""
    name = f"regexp_replace({host}, '{AROUND_NAME}', '', 'g')"
    last = lambda k: f"array_to_string(list_slice(string_split({name}, '.'), -({k}), -1), '.')"
    known = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    return f"CASE WHEN regexp_matches({name}, '{NUMERIC}') THEN {name} WHEN {last(2)} IN ({known}) THEN {last(2 + more)} ELSE {last(1 + more)} END"


def _strength_sql(table: str, n: str, g: str, m: str) -> str:
    return (
        f"(SELECT CASE WHEN u < 3 OR w - z = 0 OR w IS NULL OR (s - z) / (w - z) <= 0 THEN {STRONG} ELSE greatest({WEAK}, least({STRONG}, 1 / greatest((s - z) / (w - z), 1e-9) - 1)) END"
        f" FROM (SELECT count(*) u, sum({n} * pow({g} / {n} - {m}, 2)) s, sum({m} * (1 - {m})) z, sum({n} * {m} * (1 - {m})) w FROM {table} WHERE {n} > 0))"
    )


def oracle(rules=RULES, least_good: float = LEAST_GOOD, z: float = Z) -> str:
    """DuckDB SQL for the rows of op1."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"((host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}'))" for h, p, _ in ranked]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ranked)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ranked)) + " END"
    return f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path,
    try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/[^/?#]*/([0-9]{{1,18}})(?:[.]html?)?(?:[/?#]|$)', 1) AS BIGINT) doc_id FROM pages),
said AS (SELECT doc_id, min((coalesce(quality, 1) >= 1 AND coalesce(toxic, 0) <= 0)::INT) good FROM labels GROUP BY doc_id),
outcome AS (SELECT page_id, min(good) good FROM (SELECT DISTINCT page_id, doc_id FROM parsed) p JOIN said USING (doc_id) GROUP BY page_id),
hosts AS (SELECT host, {_labels_sql('host', 1)} dom, {_labels_sql('host', 0)} suf, count(good)::DOUBLE n, sum(CASE WHEN good = 1 THEN 1 ELSE 0 END)::DOUBLE g
  FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY host),
domains AS (SELECT dom, suf, sum(n) dn, sum(g) dg FROM hosts GROUP BY dom, suf),
suffixes AS (SELECT suf, sum(dn) sn, sum(dg) sg FROM domains GROUP BY suf),
s0 AS (SELECT *, (SELECT (sum(sg) + 1) / (sum(sn) + 1) FROM suffixes) m0 FROM suffixes),
s1 AS (SELECT suf, (k * m0 + sg) / (k + sn) m_s FROM s0, (SELECT {_strength_sql('s0', 'sn', 'sg', 'm0')} k) q),
d0 AS (SELECT dom, suf, dn, dg, m_s FROM domains JOIN s1 USING (suf)),
d1 AS (SELECT dom, suf, (k * m_s + dg) / (k + dn) m_d FROM d0, (SELECT {_strength_sql('d0', 'dn', 'dg', 'm_s')} k) q),
h0 AS (SELECT host, n, g, m_d FROM hosts JOIN d1 USING (dom, suf)),
h1 AS (SELECT host, n, g, k * m_d + g a, k * (1 - m_d) + n - g b FROM h0, (SELECT {_strength_sql('h0', 'n', 'g', 'm_d')} k) q),
h2 AS (SELECT host, n::BIGINT n_labelled, g::BIGINT n_good, a / (a + b) post_mean, least(1.0, a / (a + b) + {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) upper_good FROM h1)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN upper_good < {least_good} THEN 'block' ELSE 'allow' END) AS verdict,
  n_labelled, n_good, round(post_mean, {DIGITS}) AS post_mean, round(upper_good, {DIGITS}) AS upper_good
FROM parsed JOIN h2 USING (host)
"""
