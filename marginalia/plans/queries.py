"""One query for each operator over the tables of a folder, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.functions import words
from marginalia.operators import cells as N
from marginalia.operators import chunks as C
from marginalia.operators import density as D
from marginalia.operators import evaluation as E
from marginalia.operators import grounding as G
from marginalia.operators import index as I
from marginalia.operators import listing as L
from marginalia.operators import router as R
from marginalia.operators import search as Q
from marginalia.operators import vectors as V
from marginalia.plans import sqltext as X
from marginalia.plans import testdata as A
from marginalia.sources import jsonl
from marginalia.sources import manifest as M
from marginalia.sources.keyed import KeyedTable
from marginalia.sources.scratch import kept, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(name: str):
    return F.round(name, 6).alias(name)


# Density: counted strings of each note.

_DENSITY = {
    "ip": "list_filter(regexp_extract_all(t, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'), lambda a: len(list_filter(string_split(a, '.'), lambda o: o::INT > 255)) = 0)",
    "email": "list_transform(regexp_extract_all(t, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b'), lambda a: lower(a))",
    "url": "list_filter(list_transform(regexp_extract_all(t, '\\bhttps?://[^\\s<>''\"`]+'), lambda u: regexp_replace(u, '[.,;:!?)\\]}]+$', '')), lambda u: u <> '')",
    "api_key": " || ".join(f"regexp_extract_all(t, {X.quote(p)})" for p in words.API_KEYS),
    "credit_card": "list_filter(list_transform(regexp_extract_all(t, '\\b(?:\\d[ -]?){13,19}\\b'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')), lambda c: length(c) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN (length(c) - i) % 2 = 1 THEN (CASE WHEN 2 * substr(c, i, 1)::INT > 9 THEN 2 * substr(c, i, 1)::INT - 9 ELSE 2 * substr(c, i, 1)::INT END) ELSE substr(c, i, 1)::INT END)) % 10 = 0)",
    "sql": "list_transform(list_filter(list_transform(regexp_extract_all(t, '(?is)(?:^|[;\\n])\\s*((?:" + words.SQL_VERBS + ")\\b[\\s\\S]{1,600}?[\\s\\S]{0,600}?;)', 1) || regexp_extract_all(t, '(?im)^\\s*(?:" + words.SQL_VERBS + ")\\b[^\\n;]{6,}$'), lambda s: lower(trim(s, E' \\n\\t\\r'))), lambda s: s <> '' AND NOT ((prefix(s, 'select') OR prefix(s, 'with')) AND NOT contains(s, ' from '))), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')))",
}


def _density_sql(target: str, rows: str) -> str:
    return f"WITH n AS ({rows}), m AS (SELECT rel_path, {_DENSITY[target]} m FROM n) SELECT rel_path, len(m)::BIGINT AS total, len(list_distinct(m))::BIGINT AS uniques FROM m WHERE len(m) > 0"


_DOC_ROWS = "SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' rel_path, text t FROM documents"
_PAGE_ROWS = "SELECT 'page_' || page_id rel_path, html || ' ' || url t FROM pages"
_URL_ROWS = "SELECT 'page_' || page_id rel_path, url || ' and ' || url || '). See ' || url || '#a' t FROM pages"
#: Keys and statements do not occur in the tables; these rows carry them beside each event.
_KEY_ROWS = "SELECT 'event_' || event_id rel_path, 'key AKIA' || upper(lpad(user_id::VARCHAR, 16, 'A')) || ' and sk-' || lpad(event_id::VARCHAR, 18, 'x') || ', sk-short' t FROM events"
_SQL_ROWS = "SELECT 'event_' || event_id rel_path, 'notes' || chr(10) || 'SELECT a, b' || chr(10) || ' FROM t' || user_id || ' WHERE x;' || chr(10) || 'delete from ' || event_type || chr(10) || 'with regards' t FROM events"


def _density(name: str, target: str, rows: str, notes) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.density(notes(spark, sf_dir), target)

    run.__name__ = name
    query(_density_sql(target, rows))(run)


def _pages(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("rel_path"), F.concat("html", F.lit(" "), "url").alias("text"))


def _page_urls(spark, sf_dir):
    u = F.col("url")
    return A.table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("rel_path"), F.concat(u, F.lit(" and "), u, F.lit("). See "), u, F.lit("#a")).alias("text"))


def _event_keys(spark, sf_dir):
    text = F.concat(F.lit("key AKIA"), F.upper(F.lpad(F.col("user_id").cast("string"), 16, "A")), F.lit(" and sk-"), F.lpad(F.col("event_id").cast("string"), 18, "x"), F.lit(", sk-short"))
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("rel_path"), text.alias("text"))


def _event_sql(spark, sf_dir):
    text = F.concat(F.lit("notes\nSELECT a, b\n FROM t"), F.col("user_id").cast("string"), F.lit(" WHERE x;\ndelete from "), F.col("event_type"), F.lit("\nwith regards"))
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("rel_path"), text.alias("text"))


_density("density_ip_counts", "ip", _DOC_ROWS, A.notes)
_density("density_email", "email", _DOC_ROWS, A.notes)
_density("density_card", "credit_card", _DOC_ROWS, A.notes)
_density("density_sql", "sql", _DOC_ROWS, A.notes)
_density("density_url", "url", _URL_ROWS, _page_urls)
_density("density_url_pages", "url", _PAGE_ROWS, _pages)
_density("density_api_key", "api_key", _KEY_ROWS, _event_keys)
_density("density_sql_blocks", "sql", _SQL_ROWS, _event_sql)


@query(_density_sql("ip", _DOC_ROWS) + " ORDER BY total DESC, uniques DESC, rel_path DESC LIMIT 10")
def density_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten notes with most IP addresses."""
    return D.densest(A.notes(spark, sf_dir), "ip")


# Text functions.


@query(f"WITH {X.NOTES}, d AS (SELECT rel_path, {X.tokens('text')} tk, {X.lines('text')} ln, text FROM notes) SELECT rel_path, len(tk)::BIGINT AS n_tokens, len(list_distinct(tk))::BIGINT AS n_distinct, len(ln)::BIGINT AS n_lines, {X.snippet('text')} AS snippet FROM d")
def token_stats(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return A.notes(spark, sf_dir).select("rel_path", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), T.trim_snippet(F.col("text")).alias("snippet"))


@query(f"SELECT p_partkey, {X.basename('p')} AS base, {X.stem('p')} AS stem, sha256('m' || chr(10) || p) AS cache_key FROM (SELECT p_partkey, p_type || '/' || p_name || '.' || p_brand || '.md' p FROM part)")
def path_parts(spark, sf_dir):
    p = F.concat("p_type", F.lit("/"), "p_name", F.lit("."), "p_brand", F.lit(".md"))
    return A.table(spark, sf_dir, "part").select("p_partkey", T.basename(p).alias("base"), T.stem(p).alias("stem"), T.cache_key(F.lit("m"), p).alias("cache_key"))


@query(f"WITH {X.NOTES} SELECT rel_path, coalesce(substr(list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> ''), 1), 1, 200), '') AS first_line, length(text) // 2 AS at, length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1 AS line_no FROM notes")
def line_positions(spark, sf_dir):
    at = F.floor(F.length("text") / F.lit(2)).cast("int")
    return A.notes(spark, sf_dir).select("rel_path", T.first_nonempty_line(F.col("text")).alias("first_line"), at.cast("long").alias("at"), T.line_of(F.col("text"), at).cast("long").alias("line_no"))


@query(
    "WITH t AS (SELECT event_id, '# Top' || chr(10) || 'a' || chr(10) || '## ' || event_type || chr(10) || 'b' || chr(10) || '#!' || chr(10) || '###' || chr(10) || 'c' x, (1 + event_id % 8)::INT s FROM events), "
    "l AS (SELECT event_id, s, unnest(string_split(x, chr(10))) ln, generate_subscripts(string_split(x, chr(10)), 1) i FROM t), "
    "h AS (SELECT event_id, s, arg_max(trim(ltrim(ln, '#')), i) hd FROM l WHERE i < s AND prefix(ln, '#') GROUP BY event_id, s) "
    "SELECT t.event_id, t.s AS start_line, nullif(hd, '') AS heading FROM t LEFT JOIN h USING (event_id)"
)
def heading_context(spark, sf_dir):
    text = F.concat(F.lit("# Top\na\n## "), F.col("event_type"), F.lit("\nb\n#!\n###\nc"))
    s = (1 + F.col("event_id") % 8).cast("int")
    return A.table(spark, sf_dir, "events").select("event_id", s.alias("start_line"), T.heading_before(T.lines(text), s).alias("heading"))


# Scores of every search of the batch against every note (or path).

_PAIRS = f"WITH {X.SEARCH_ROWS}, {X.features('q0')}, {X.NOTES}, d AS (SELECT rel_path, {X.tokens('text')} dt, lower(text) low, {X.norm('text')} nm FROM notes) "


def _pairs(spark, sf_dir):
    d = A.notes(spark, sf_dir).select("rel_path", S.text_features(F.col("text")).alias("d"))
    q = Q.with_features(A.searches(spark, sf_dir, embedded=False)).select("query_id", "q")
    return d.crossJoin(F.broadcast(q))


def _score(name: str, value, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("query_id", "rel_path", F.round(value(F.col("q"), F.col("d")), 6).alias("score")).where("score > 0")

    run.__name__ = name
    query(_PAIRS + f"SELECT query_id, rel_path, round({sql}, 6) AS score FROM d, q WHERE round({sql}, 6) > 0")(run)


_score("keyword_score", lambda q, d: S.keyword(q["toks"], d["tokens"]), X.keyword("q.toks", "dt"))
_score("keyword_score_all_tokens", lambda q, d: S.keyword(q["all_tokens"], d["tokens"]), X.keyword("q.all_tokens", "dt"))
_score("text_score", lambda q, d: S.text_match(q["phrase"], q["toks"], d["lower"], d["tokens"]), X.text_match("q.phrase", "q.toks", "low", "dt"))
_score("phrase_score", lambda q, d: S.phrase_match(q, d["norm"]), X.phrase_match("q", "nm"))
_score("ordered_score", lambda q, d: S.ordered_match(q["toks"], d["norm"]), X.ordered("q.toks", "nm"))


@query(f"WITH {X.SEARCH_ROWS}, {X.features('q0')}, {X.NOTES} SELECT query_id, rel_path, round({X.literal('terms', 'lower(rel_path)')}, 6) AS score FROM notes, q WHERE len(terms) > 0")
def literal_score(spark, sf_dir):
    n = A.notes(spark, sf_dir).select("rel_path", F.lower("rel_path").alias("low"))
    q = Q.with_features(A.searches(spark, sf_dir, embedded=False)).where(F.size("q.terms") > 0).select("query_id", "q")
    return n.crossJoin(F.broadcast(q)).select("query_id", "rel_path", F.round(S.literal_match(F.col("q")["terms"], F.col("low")), 6).alias("score"))


_PART_QUERIES = ("find the note about blue", "part 12 config", "green.json", "anodized steel", "show my file red key")
_PART_SQL = "q0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {X.quote(q)})" for i, q in enumerate(_PART_QUERIES)) + ") v(query_id, query))"


@query(f"WITH {_PART_SQL}, {X.features('q0')}, p AS (SELECT p_partkey, p_name || '.md' path FROM part) SELECT query_id, p_partkey, round({X.filename('q', 'path')}, 6) AS score FROM p, q")
def filename_score(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", S.path_features(F.concat("p_name", F.lit(".md"))).alias("p"))
    q = Q.with_features(spark.createDataFrame(list(enumerate(_PART_QUERIES)), "query_id long, query string")).select("query_id", "q")
    return p.crossJoin(F.broadcast(q)).select("query_id", "p_partkey", F.round(S.filename_match(F.col("q"), F.col("p")), 6).alias("score"))


_META_SQL = f"m0 AS (SELECT rel_path, {X.metadata_text('rel_path', 'NULL', 'string_split(text, chr(10))[1]')} mt FROM notes), m AS (SELECT rel_path, {X.tokens('mt')} mtk, lower(mt) mlow, {X.norm('mt')} mnm FROM m0)"
_META = f"CASE WHEN mnm = '' THEN 0.0 ELSE greatest({X.phrase_match('q', 'mnm')}, {X.ordered('q.toks', 'mnm')}, {X.text_match('q.phrase', 'q.toks', 'mlow', 'mtk')}, {X.keyword('q.toks', 'mtk')}) END"


@query(f"WITH {X.SEARCH_ROWS}, {X.features('q0')}, {X.NOTES}, {_META_SQL} SELECT query_id, rel_path, round({_META}, 6) AS score FROM m, q")
def metadata_score(spark, sf_dir):
    n = A.notes(spark, sf_dir)
    m = n.select("rel_path", S.text_features(S.metadata_text(F.col("rel_path"), F.lit(None).cast("string"), F.get(T.lines(F.col("text")), 0))).alias("m"))
    q = Q.with_features(A.searches(spark, sf_dir, embedded=False)).select("query_id", "q")
    return m.crossJoin(F.broadcast(q)).select("query_id", "rel_path", F.round(S.metadata_match(F.col("q"), F.col("m")), 6).alias("score"))


_TURN_KIND = "SELECT conv_id, turn, " + X.kind("text") + " AS kind FROM conversations"


@query(_TURN_KIND)
def query_type(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_type(F.col("text")).alias("kind"))


@query()
def route_query(spark, sf_dir):
    """The fixed batch of inputs and every turn of the conversations, routed. (No SQL: see the unit tests.)"""
    fixed = spark.createDataFrame([(-1, i, t) for i, t in enumerate(A.INPUTS)], "conv_id long, turn long, text string")
    x = fixed.unionByName(A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", R.route(F.col("text")).alias("r"), R.density_target(F.col("text")).alias("target"))
    return x.select("conv_id", "turn", "r.mode", "r.confidence", F.array_join("r.reasons", "; ").alias("reasons"), "r.command_name", "r.note_path_hint", "r.note_result_index", "target")


_SIGNALS = (
    f"WITH n AS (SELECT conv_id, turn, {X.norm('text')} x FROM conversations) SELECT conv_id, turn, array_to_string(list_filter([CASE "
    + " ".join(f"WHEN contains(x, {X.quote(p)}) THEN {X.quote(f"matched phrase '{p}'")}" for p in words.SEARCH_PHRASES)
    + f" END, CASE WHEN regexp_matches(x, {X.quote(words.PERSONAL_MEMORY)}) THEN 'personal memory wording' END, CASE WHEN regexp_matches(x, {X.quote(words.NOUNS)}) AND regexp_matches(x, {X.quote(words.SEARCH_VERBS)}) THEN 'notes noun + search wording' END, "
    + f"CASE WHEN prefix(x, 'find ') AND regexp_matches(x, {X.quote(words.NOUNS)}) THEN 'find query aimed at files or notes' END], lambda s: s IS NOT NULL), '; ') AS signals FROM n"
)


@query(_SIGNALS)
def search_signals(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(R.search_signals(T.normalize(F.col("text"))), "; ").alias("signals"))


# Vectors.

_L2 = "list_sum(list_transform(list_zip(v.embedding, s.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_KNN_ROWS = f"s AS (SELECT query_id, query, embedding FROM q0 JOIN embeddings ON vec_id = query_id), c AS (SELECT vec_id id, embedding FROM embeddings JOIN documents ON doc_id = vec_id), a AS (SELECT query_id, id, {_L2} distance FROM c v, s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) rank FROM a)"
_KNN = f"{X.SEARCH_ROWS}, {_KNN_ROWS}"


@query(f"WITH {_KNN} SELECT query_id, id, rank::INT AS rank, round(distance, 6) AS distance FROM k WHERE rank <= 30")
def knn_topk(spark, sf_dir):
    return V.nearest(A.searches(spark, sf_dir), A.chunks(spark, sf_dir).select("id", "embedding"), 30).select("query_id", "id", "rank", r6("distance"))


_ITEM_KNN = f"WITH s AS (SELECT item_id query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id), a AS (SELECT query_id, vec_id id, {_L2} distance FROM embeddings v, s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) rank FROM a)"


@query(_ITEM_KNN + " SELECT query_id, id, rank::INT AS rank, round(distance, 6) AS distance FROM k WHERE rank <= 30")
def knn_cells(spark, sf_dir):
    """The neighbours of every benchmark item's vector among all vectors, through the index of cells."""
    index = N.build(A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return N.nearest(index, A.items(spark, sf_dir), 30).select("query_id", "id", "rank", r6("distance"))


@query("SELECT (SELECT count(*) FROM benchmark JOIN embeddings ON vec_id = item_id) AS queries, (SELECT count(*) FROM embeddings) AS vectors, true AS under_half")
def knn_cells_read(spark, sf_dir):
    """How many of the vectors that search compares in full: less than half of all pairs."""
    vectors, items = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), A.items(spark, sf_dir)
    index, n = N.build(vectors), items.count()
    return N.share_read(index, N.candidates(index, items, 30), n).select(F.lit(n).cast("long").alias("queries"), F.lit(index.vectors).cast("long").alias("vectors"), (F.col("share") < 0.5).alias("under_half"))


@query(f"WITH {_KNN} SELECT query_id, id, round(1 - (rank - 1) / 49.0, 6) AS score FROM k WHERE rank <= 50")
def semantic_rank(spark, sf_dir):
    near = V.nearest(A.searches(spark, sf_dir), A.chunks(spark, sf_dir).select("id", "embedding"), 50)
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return near.select("query_id", "id", F.round(S.rank_score(F.col("rank"), total), 6).alias("score"))


_RERANK = f"{_KNN}, h AS (SELECT k.query_id, id, rank, {X.tokens('s.query')} qt, {X.tokens('text')} dt, text FROM k JOIN s USING (query_id) JOIN documents ON doc_id = id WHERE rank <= 30), h2 AS (SELECT *, 0.75 * (1 - (rank - 1) / 29.0::DOUBLE) + 0.25 * ({X.keyword('qt', 'dt')}) score FROM h), h3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) new_rank FROM h2)"


def _reranked(spark, sf_dir, k=10):
    q = A.searches(spark, sf_dir)
    return V.hybrid_rerank(q, V.nearest(q, A.chunks(spark, sf_dir), 3 * k), k)


@query(f"WITH {_RERANK} SELECT query_id, id, new_rank::INT AS new_rank, round(score, 6) AS score FROM h3 WHERE new_rank <= 10")
def hybrid_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "id", "new_rank", r6("score"))


_BUDGET = f"{_RERANK}, b AS (SELECT query_id, id, new_rank, text, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY new_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) bef FROM h3 WHERE new_rank <= 10)"


@query(f"WITH {_BUDGET} SELECT query_id, id, new_rank::INT AS new_rank, substr(text, 1, (9000 - bef)::INT) AS text FROM b WHERE bef < 9000")
def retrieve_budget(spark, sf_dir):
    return V.within_budget(_reranked(spark, sf_dir), 9000).select("query_id", "id", "new_rank", "text")


# Channels and ranked search.

_NAME_CHANNEL = (
    f"f0 AS (SELECT query_id, rel_path, q.kind kind, text, {X.filename('q', 'rel_path')} f FROM notes, q), "
    f"f1 AS (SELECT *, list_filter(list_transform({X.lines('text')}, lambda x, i: {{'x': trim(x, E' \\t\\r'), 'i': i}}), lambda y: y.x <> '')[1] pv FROM f0 WHERE f >= 0.55), "
    f"nc AS (SELECT query_id, rel_path, pv.i::INT start_line, pv.i::INT end_line, {X.snippet('coalesce(pv.x, rel_path)')} snippet, CASE kind WHEN 'filename_focus' THEN 0.90 + 0.09 * f WHEN 'mixed' THEN 0.72 + 0.18 * f ELSE 0.62 + 0.15 * f END score, 'filename' reasons, 1 channel, 0 place FROM f1)"
)
_SEARCH = f"{X.SEARCH_ROWS}, {X.features('q0')}, {X.NOTES}"


@query(f"WITH {_SEARCH}, {_NAME_CHANNEL} SELECT query_id, rel_path, start_line, end_line, snippet, round(score, 6) AS score FROM nc")
def filename_channel(spark, sf_dir):
    return Q.filename_channel(Q.with_features(A.searches(spark, sf_dir, embedded=False)), A.notes(spark, sf_dir)).select("query_id", "rel_path", "start_line", "end_line", "snippet", r6("score"))


_LINES = (
    f"ln AS (SELECT rel_path, unnest({X.lines('text')}) c, generate_subscripts({X.lines('text')}, 1) - 1 line FROM notes), "
    f"ld AS (SELECT rel_path, line, c, {X.tokens('c')} lt, lower(c) low, {X.norm('c')} nm FROM ln), "
    "lq AS (SELECT *, least(0.30, (CASE WHEN prefix(trim(c), '#') OR prefix(trim(c), '-') OR suffix(trim(c), ':') THEN 0.18 WHEN len(lt) <= 6 THEN 0.10 ELSE 0 END)::DOUBLE + 0.12 * greatest(0, 1 - least(length(nm), 180) / 180.0::DOUBLE)) quality FROM ld), "
    f"ls AS (SELECT query_id, rel_path, line, quality, {X.phrase_match('q', 'nm')} phrase, {X.text_match('q.phrase', 'q.toks', 'low', 'lt')} text_s, {X.keyword('q.toks', 'lt')} kw, {X.literal('q.terms', 'low')} lit, {X.ordered('q.toks', 'nm')} ord FROM lq, q WHERE QKIND), "
    "bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY greatest(phrase, text_s, kw, ord, lit) DESC, lit DESC, phrase DESC, ord DESC, text_s DESC, kw DESC, quality DESC, line) rn FROM ls) WHERE rn = 1)"
)


@query(f"WITH {_SEARCH}, {_LINES.replace('QKIND', 'true')} SELECT query_id, rel_path, line::INT AS line, round(phrase, 6) AS phrase, round(text_s, 6) AS text, round(kw, 6) AS keyword, round(lit, 6) AS literal, round(ord, 6) AS ordered, round(quality, 6) AS quality FROM bl")
def best_snippet(spark, sf_dir):
    b = Q.best_lines(Q.with_features(A.searches(spark, sf_dir, embedded=False)), A.notes(spark, sf_dir))
    return b.select("query_id", "rel_path", "line", *[r6(c) for c in ("phrase", "text", "keyword", "literal", "ordered", "quality")])


def _window_sql(ls: str, at: str) -> str:
    return X.snippet(f"array_to_string(list_slice({ls}, greatest({at}, 1), least(len({ls}), {at} + 2)), chr(10))")


_LADDER = (
    "CASE WHEN lit >= 0.99 AND ord >= 0.99 THEN least(0.995, 0.84 + 0.05 * lit + 0.04 * ord + 0.05 * quality + 0.03 * f + 0.03 * md) "
    "WHEN lit >= 0.99 AND (text_s >= 0.95 OR kw >= 0.95) THEN least(0.985, 0.80 + 0.05 * lit + 0.04 * text_s + 0.03 * kw + 0.05 * quality + 0.02 * f) "
    "WHEN phrase >= 0.99 AND ord >= 0.99 AND quality >= 0.18 THEN least(0.992, 0.82 + 0.05 * phrase + 0.04 * ord + 0.06 * quality + 0.03 * f + 0.03 * md) "
    "WHEN ord >= 0.99 AND quality >= 0.18 THEN least(0.975, 0.79 + 0.05 * ord + 0.06 * quality + 0.03 * md + 0.02 * f) "
    "WHEN ord >= 0.99 THEN least(0.965, 0.77 + 0.05 * ord + 0.04 * quality + 0.03 * md) "
    "WHEN phrase >= 0.99 THEN least(0.96, 0.76 + 0.05 * phrase + 0.04 * quality + 0.03 * md + 0.02 * f) "
    "WHEN text_s >= 0.99 AND kw >= 0.99 THEN least(0.93, 0.72 + 0.04 * text_s + 0.04 * kw + 0.06 * quality + 0.03 * md + 0.02 * f) "
    "WHEN phrase >= 0.62 AND text_s >= 0.80 THEN least(0.985, 0.93 + quality) "
    "ELSE least(0.98, 0.58 * phrase + 0.24 * text_s + 0.12 * kw + 0.06 * md + 0.08 * f + quality + 0.04 * ord) END"
)
_TEXT_CHANNEL = (
    f"{_LINES.replace('QKIND', chr(39) + 'snippet_focus' + chr(39) + ' = q.kind')}, {_META_SQL}, "
    f"t0 AS (SELECT bl.*, n.text, {X.lines('n.text')} lns, {X.filename('q', 'bl.rel_path')} f, {_META} md FROM bl JOIN notes n USING (rel_path) JOIN q USING (query_id) JOIN m USING (rel_path) WHERE bl.phrase >= 0.62 OR (text_s >= 0.55 AND kw >= 0.50)), "
    f"tc AS (SELECT query_id, rel_path, (greatest(line - 1, 0) + 1)::INT start_line, least(len(lns), line + 2)::INT end_line, {_window_sql('lns', 'line')} snippet, {_LADDER} score, CASE WHEN phrase >= 0.62 THEN 'phrase, keyword' ELSE 'text, keyword' END reasons, 2 channel, 0 place FROM t0)"
)


@query(f"WITH {_SEARCH}, {_TEXT_CHANNEL} SELECT query_id, rel_path, start_line, end_line, snippet, round(score, 6) AS score, reasons FROM tc")
def text_channel(spark, sf_dir):
    x = Q.text_channel(Q.with_features(A.searches(spark, sf_dir, embedded=False)), A.notes(spark, sf_dir))
    return x.select("query_id", "rel_path", "start_line", "end_line", "snippet", r6("score"), F.array_join("reasons", ", ").alias("reasons"))


_ITEM_ROWS = "q0 AS (SELECT item_id query_id, 'find the passage ' || replace(text, chr(10), ' ') query FROM benchmark)"


@query(f"WITH {_ITEM_ROWS}, {X.features('q0')}, {X.NOTES}, {_TEXT_CHANNEL} SELECT query_id, rel_path, start_line, end_line, round(score, 6) AS score, reasons FROM tc")
def passage_search(spark, sf_dir):
    """Every benchmark item, as a whole, looked for in all lines of all notes."""
    x = Q.text_channel(Q.with_features(A.passages(spark, sf_dir)), A.notes(spark, sf_dir))
    return x.select("query_id", "rel_path", "start_line", "end_line", r6("score"), F.array_join("reasons", ", ").alias("reasons"))


_SEM = {"semantic": "sem", "keyword": "kw", "filename": "f", "text": "tx", "metadata": "md", "phrase": "ph"}
_RELEVANCE = f"CASE WHEN {X.norm('x')} = '' THEN 0.0 ELSE greatest({X.phrase_match('c3', X.norm('x'))}, {X.text_match('c3.phrase', 'c3.toks', 'lower(x)', X.tokens('x'))}, {X.keyword('c3.toks', X.tokens('x'))}) END"
_SEM_CHANNEL = (
    f"{_KNN_ROWS}, "
    "c1 AS (SELECT k.query_id, k.id, k.rank, q.toks, q.phrase, q.g4, q.g3, q.g2, q.kind, n.rel_path, n.text FROM k JOIN q USING (query_id) JOIN notes n ON n.doc_id = k.id WHERE rank <= 40), "
    f"c2 AS (SELECT c1.*, {X.lines('text')} lns, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')[1], 1, 200), '') fl, lower(text) low, {X.tokens('text')} dt, {X.norm('text')} nm, count(*) OVER (PARTITION BY query_id) total FROM c1), "
    f"c3 AS (SELECT c2.*, {X.tokens('mt')} mtk, lower(mt) mlow, {X.norm('mt')} mnm FROM (SELECT *, {X.metadata_text('rel_path', 'NULL', 'fl')} mt FROM c2) c2), "
    f"cx AS (SELECT query_id, id, unnest(lns) x, generate_subscripts(lns, 1) - 1 i, toks, phrase, g4, g3, g2 FROM c3), "
    f"cy AS (SELECT query_id, id, i li FROM (SELECT query_id, id, i, row_number() OVER (PARTITION BY query_id, id ORDER BY {_RELEVANCE.replace('c3', 'cx')} DESC, i) rn FROM cx) WHERE rn = 1), "
    f"c4 AS (SELECT c3.*, li, 1 - (rank - 1) / greatest(total - 1, 1)::DOUBLE sem, {X.keyword('c3.toks', 'dt')} kw, {X.filename('c3', 'rel_path')} f, {X.text_match('c3.phrase', 'c3.toks', 'low', 'dt')} tx, {_META.replace('q.', 'c3.').replace('q,', 'c3,')} md, {X.phrase_match('c3', 'nm')} ph FROM c3 LEFT JOIN cy USING (query_id, id)), "
    f"sc AS (SELECT query_id, rel_path, CASE WHEN li IS NULL THEN 1 ELSE 1 + greatest(li - 1, 0) END::INT start_line, CASE WHEN li IS NULL THEN greatest(len(lns), 1) ELSE least(least(len(lns), li + 2), greatest(len(lns), 1)) END::INT end_line, CASE WHEN li IS NULL THEN {X.snippet('text')} ELSE {_window_sql('lns', 'li')} END snippet, {X.weighted('kind', _SEM)} score, "
    "CASE WHEN f < 0.45 AND ph < 0.6 AND md < 0.45 AND tx < 0.45 AND kw < 0.35 AND sem < 0.45 THEN 'semantic' ELSE concat_ws(', ', CASE WHEN f >= 0.45 THEN 'filename' END, CASE WHEN ph >= 0.6 THEN 'phrase' END, CASE WHEN md >= 0.45 THEN 'heading' END, CASE WHEN tx >= 0.45 THEN 'text' END, CASE WHEN kw >= 0.35 THEN 'keyword' END, CASE WHEN sem >= 0.45 THEN 'semantic' END) END reasons, 0 channel, rank place FROM c4)"
)


@query(f"WITH {_SEARCH}, {_SEM_CHANNEL} SELECT query_id, rel_path, start_line, end_line, snippet, round(score, 6) AS score, reasons FROM sc")
def semantic_channel(spark, sf_dir):
    x = Q.semantic_channel(Q.with_features(A.searches(spark, sf_dir)), A.chunks(spark, sf_dir), Q.fetch_size(8, 10))
    return x.select("query_id", "rel_path", "start_line", "end_line", "snippet", r6("score"), F.array_join("reasons", ", ").alias("reasons"))


_ALL = "query_id, rel_path, start_line, end_line, snippet, score, reasons, channel, place"


@query(
    f"WITH {_SEARCH}, {_SEM_CHANNEL}, {_NAME_CHANNEL}, {_TEXT_CHANNEL}, "
    f"al AS (SELECT {_ALL} FROM sc UNION ALL SELECT {_ALL} FROM nc UNION ALL SELECT {_ALL} FROM tc WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.query_id = tc.query_id AND nc.rel_path = tc.rel_path AND nc.start_line IS NOT DISTINCT FROM tc.start_line AND nc.end_line IS NOT DISTINCT FROM tc.end_line)), "
    "p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY score DESC, nullif(start_line, 0) NULLS LAST, channel, place) rn FROM al), "
    "p2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rel_path) rank FROM p1 WHERE rn = 1) "
    "SELECT query_id, rank::INT AS rank, rel_path, start_line, end_line, snippet, round(score, 6) AS score, reasons, kind AS query_type FROM p2 JOIN q USING (query_id) WHERE rank <= 8"
)
def search_ranked(spark, sf_dir):
    hits = Q.search(A.searches(spark, sf_dir), A.notes(spark, sf_dir), A.chunks(spark, sf_dir))
    return hits.select("query_id", "rank", "rel_path", "start_line", "end_line", "snippet", r6("score"), F.array_join("reasons", ", ").alias("reasons"), "query_type")


# Listing and reading.


@query(f"WITH {X.NOTES} SELECT rel_path, contains(lower(rel_path), 'src1') AS filename_match, contains(lower(text), 'that for') AS text_match FROM notes WHERE contains(lower(rel_path), 'that for') OR contains(lower(text), 'that for') ORDER BY rel_path LIMIT 100".replace("contains(lower(rel_path), 'src1') AS", "contains(lower(rel_path), 'that for') AS"))
def find_files(spark, sf_dir):
    return L.find_files(A.notes(spark, sf_dir), "That for ", "both", 100)


@query(f"WITH {X.NOTES} SELECT rel_path, true AS filename_match, false AS text_match FROM notes WHERE contains(lower(rel_path), '/src1') ORDER BY rel_path LIMIT 100")
def find_files_by_name(spark, sf_dir):
    return L.find_files(A.notes(spark, sf_dir), "/src1", "filename", 100)


@query(f"WITH {X.NOTES} SELECT rel_path, (SELECT count(*) FROM notes) AS total, (SELECT count(*) FROM notes) > 150 AS has_more FROM notes ORDER BY rel_path LIMIT 100 OFFSET 50")
def list_files_page(spark, sf_dir):
    return L.page(A.notes(spark, sf_dir).select("rel_path"), 100, 50)


@query(f"WITH {X.NOTES} SELECT rel_path, size, round(size / 1048576.0::DOUBLE, 3) AS size_mb FROM notes WHERE size >= 0.004 * 1048576 ORDER BY rel_path LIMIT 500")
def large_files(spark, sf_dir):
    return L.large_files(A.notes(spark, sf_dir).select("rel_path", "size"), 0.004, 500)


@query(
    f"WITH {X.NOTES}, r AS (SELECT rel_path, (doc_id % 9)::INT a, (12 - doc_id % 13)::INT b, {X.lines('text')} l FROM notes), "
    "s AS (SELECT rel_path, l, greatest(1, coalesce(nullif(a, 0), 1)) x, least(len(l), coalesce(nullif(b, 0), len(l))) y FROM r), "
    "t AS (SELECT rel_path, l, least(x, y)::INT start_line, greatest(x, y)::INT end_line, len(l)::INT total_lines FROM s) "
    "SELECT rel_path, start_line, end_line, total_lines, substr(array_to_string(list_slice(l, greatest(start_line, 1), end_line), chr(10)), 1, 500) AS text, length(substr(array_to_string(list_slice(l, greatest(start_line, 1), end_line), chr(10)), 1, 500)) >= 500 AS truncated FROM t"
)
def note_excerpt(spark, sf_dir):
    n = A.notes(spark, sf_dir)
    asked = n.select("rel_path", (F.col("doc_id") % 9).cast("int").alias("start_line"), (12 - F.col("doc_id") % 13).cast("int").alias("end_line"))
    return L.excerpts(asked, n, 500)


_HINTS = ("en/src3/doc_63.txt", "DOC_12.txt", "./src7/doc_27.txt", "doc_5.txt", "nothing.md", "b/doc_9.txt")


@query(
    f"WITH {X.NOTES}, h AS (SELECT unnest({X.names(_HINTS)}) hint), g AS (SELECT hint, lower(regexp_replace(hint, '^(\\./|/)+', '')) k FROM h), "
    "x AS (SELECT hint, rel_path, CASE WHEN lower(rel_path) = k THEN 1 WHEN suffix(lower(rel_path), '/' || k) THEN 2 WHEN list_extract(string_split(lower(rel_path), '/'), -1) = list_extract(string_split(k, '/'), -1) THEN 3 END tier FROM notes, g) "
    "SELECT hint, rel_path, tier FROM (SELECT *, min(tier) OVER (PARTITION BY hint) b FROM x WHERE tier IS NOT NULL) WHERE tier = b"
)
def resolve_path(spark, sf_dir):
    return L.resolve(spark.createDataFrame([(h,) for h in _HINTS], "hint string"), A.notes(spark, sf_dir).select("rel_path"))


# Chunks and index.


@query(
    f"WITH {X.NOTES}, n AS (SELECT rel_path, text, length(text) n FROM notes WHERE text <> ''), k AS (SELECT rel_path, text, n, unnest(range(0, CASE WHEN n <= 4000 THEN 1 ELSE ceil((n - 4000) / 3500.0)::BIGINT + 1 END)) i FROM n), "
    "c AS (SELECT rel_path, i, text, i * 3500 a, least(n, i * 3500 + 4000) b FROM k) "
    "SELECT rel_path, i::INT AS chunk_index, (1 + length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')))::INT AS start_line, (1 + length(substr(text, 1, b - 1)) - length(replace(substr(text, 1, b - 1), chr(10), '')))::INT AS end_line, trim(substr(text, a + 1, b - a), E' \\n\\t\\r') AS text FROM c"
)
def chunk_documents(spark, sf_dir):
    return C.chunk_notes(A.notes(spark, sf_dir))


@query()
def chunk_paragraphs(spark, sf_dir):
    """Notes whose line ends are doubled, so that chunks end at paragraphs, enriched. (No SQL: see the unit tests.)"""
    n = A.notes(spark, sf_dir).withColumn("text", F.concat(F.lit("# "), F.col("rel_path"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")))
    return C.enrich(C.chunk_notes(n, 1200, 100), n)


_DIFF = (
    f"WITH {X.NOTES}, o AS (SELECT rel_path, mtime - CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE 0.0 END m, size s FROM notes WHERE doc_id % 10 <> 3 UNION ALL SELECT 'en/gone/doc_' || i || '.txt', 1.0, i FROM range(100) r(i)), "
    "x AS (SELECT coalesce(n.rel_path, o.rel_path) rel_path, CASE WHEN n.rel_path IS NULL THEN 'deleted' WHEN n.size > 0.02 * 1048576 THEN 'oversize' WHEN o.rel_path IS NULL THEN 'new' WHEN n.mtime = o.m AND n.size = o.s THEN 'unchanged' ELSE 'changed' END status, coalesce(n.mtime, o.m) mtime, coalesce(n.size, o.s) size FROM notes n FULL OUTER JOIN o USING (rel_path)) "
)


def _diff(spark, sf_dir):
    return I.diff(A.notes(spark, sf_dir), A.old_manifest(spark, sf_dir), max_size_mb=0.02)


@query(_DIFF + "SELECT rel_path, status, mtime, size FROM x")
def index_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(_DIFF + "SELECT count(*) FILTER (status <> 'deleted') AS scanned, count(*) FILTER (status IN ('new', 'changed')) AS updated, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'oversize') AS errors FROM x")
def index_stats(spark, sf_dir):
    return I.stats(_diff(spark, sf_dir))


@query(_DIFF + "SELECT rel_path, mtime, size FROM x WHERE status IN ('new', 'changed', 'unchanged')")
def manifest_upsert(spark, sf_dir):
    """The manifest as a keyed table: the old rows are put in, then the changed ones take their place and the deleted ones leave; read back."""
    changes = kept(_diff(spark, sf_dir), "changes")
    table = KeyedTable(spark, new_path(spark, "manifest"), M.FILES, "rel_path")
    table.upsert(A.old_manifest(spark, sf_dir))
    table.merge(changes.where(F.col("status").isin("new", "changed")).select("rel_path", "mtime", "size"), changes.where(F.col("status").isin("deleted", "oversize")).select("rel_path"))
    return table.read()


@query(_DIFF + "SELECT rel_path, s AS size FROM o WHERE rel_path IN (SELECT 'en/gone/doc_' || i || '.txt' FROM range(3) r(i))")
def manifest_lookup(spark, sf_dir):
    """Rows of single keys, each read from its own bucket."""
    table = KeyedTable(spark, new_path(spark, "manifest"), M.FILES, "rel_path")
    table.upsert(A.old_manifest(spark, sf_dir))
    out = [table.lookup(f"en/gone/doc_{i}.txt").select("rel_path", "size") for i in range(3)]
    return out[0].union(out[1]).union(out[2])


@query("SELECT conv_id, turn, sha256('hashed' || chr(10) || text) AS cache_key, length(text)::BIGINT AS n FROM conversations")
def embedding_cache(spark, sf_dir):
    """Every turn's embedding through a cache that holds the turns of even conversations: only the others are embedded, repeats once."""
    turns = A.table(spark, sf_dir, "conversations")
    key = T.cache_key(F.lit("hashed"), F.col("text"))
    wanted = turns.select("conv_id", "turn", "text", key.alias("cache_key"), F.lit("hashed").alias("model"), F.col("text").alias("query_text"))
    cache = M.embedding_cache(spark, new_path(spark, "cache"))
    length = lambda x: x.withColumn("embedding", F.array(F.length("query_text").cast("float")))
    cache.upsert(length(wanted.where("conv_id % 2 = 0").dropDuplicates(["cache_key"])))
    return M.read_through(wanted, cache, length).select("conv_id", "turn", "cache_key", F.col("embedding")[0].cast("long").alias("n"))


# Grounding.

_PACK = f"{_RERANK}, pk AS (SELECT query_id, new_rank, rel_path, greatest(len({X.lines('h3.text')}), 1) e, '[SOURCE ' || new_rank || '] ' || rel_path || ':1-' || greatest(len({X.lines('h3.text')}), 1) || chr(10) || trim(h3.text, E' \\n\\t\\r') || chr(10) block FROM h3 JOIN notes ON doc_id = id WHERE new_rank <= 10), ps AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY new_rank) used FROM pk)"
_PACK = _PACK.replace("WITH ", "")


def _packed(spark, sf_dir):
    return G.packed_sources(_reranked(spark, sf_dir), 12_000)


@query(f"WITH {X.NOTES}, {_PACK} SELECT query_id, trim(string_agg(block, chr(10) ORDER BY new_rank), E' \\n\\t\\r') AS sources FROM ps WHERE used <= 12000 GROUP BY query_id")
def sources_block(spark, sf_dir):
    return G.sources_block(_packed(spark, sf_dir))


@query(f"WITH {X.NOTES}, {_PACK} SELECT query_id, array_to_string(list_sort(list_distinct(list(rel_path || ':1-' || e))), ' ') AS allowed FROM ps WHERE used <= 12000 GROUP BY query_id")
def citation_set(spark, sf_dir):
    return G.allowed_citations(_packed(spark, sf_dir)).select("query_id", F.array_join("allowed", " ").alias("allowed"))


_ANSWERS = ", ".join(f"(-1::BIGINT, {i}::BIGINT, {X.quote(t)})" for i, t in enumerate(A.ANSWERS))
_CITE = "'\\(([^:()]+):\\s*(\\d+)-(\\d+)\\)\\s*$'"
_VERDICT = (
    f"CASE WHEN NOT contains(b, '\"') THEN 'Evidence bullet missing quotes.' WHEN NOT regexp_matches(b, {_CITE}) THEN 'Evidence bullet missing valid citation format.' "
    f"WHEN regexp_extract(b, {_CITE}, 1) || ':' || regexp_extract(b, {_CITE}, 2) || '-' || regexp_extract(b, {_CITE}, 3) <> 'a/b.md:1-3' THEN 'Citation not in provided sources: ' || regexp_extract(b, {_CITE}, 1) || ':' || regexp_extract(b, {_CITE}, 2) || '-' || regexp_extract(b, {_CITE}, 3) END"
)


@query(
    f"WITH a AS (SELECT * FROM (VALUES {_ANSWERS}) v(conv_id, turn, text) UNION ALL SELECT conv_id, turn, 'Answer:' || chr(10) || 'x' || chr(10) || 'Evidence:' || chr(10) || '- \"' || text || '\" (a/b.md: 1-' || turn || ')' FROM conversations), "
    "e AS (SELECT *, list_filter(list_transform(string_split(substr(text, instr(text, 'Evidence:') + 9), chr(10)), lambda x: trim(x, E' \\n\\t\\r')), lambda x: prefix(x, '-')) bullets FROM a), "
    f"f AS (SELECT *, list_filter(list_transform(bullets, lambda b: {_VERDICT}), lambda r: r IS NOT NULL) bad FROM e) "
    "SELECT conv_id, turn, CASE WHEN trim(text, E' \\n\\t\\r') = 'I can''t find that in your notes.' THEN 'OK' WHEN NOT (contains(text, 'Answer:') AND contains(text, 'Evidence:')) THEN 'Missing required sections.' WHEN len(bullets) = 0 THEN 'No evidence bullets.' ELSE coalesce(bad[1], 'OK') END AS verdict FROM f"
)
def validate_answers(spark, sf_dir):
    """Fixed answers, and every turn as an answer."""
    fixed = spark.createDataFrame([(-1, i, t) for i, t in enumerate(A.ANSWERS)], "conv_id long, turn long, text string")
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('Answer:\nx\nEvidence:\n- "'), F.col("text"), F.lit('" (a/b.md: 1-'), F.col("turn").cast("string"), F.lit(")")).alias("text"))
    return fixed.unionByName(turns).select("conv_id", "turn", G.validate_answer(F.col("text"), F.array(F.lit("a/b.md:1-3"))).alias("verdict"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM conversations) WHERE k <= 4")
def recent_turns(spark, sf_dir):
    return G.recent_turns(A.table(spark, sf_dir, "conversations"), 2)


# Search log and evaluation.

_LOG = "l AS (SELECT event_id line_no, epoch_us(ts)::DOUBLE ts, event_type || ' ' || (user_id % 50) query, CASE WHEN event_id % 3 = 0 THEN 'snippet_focus' ELSE 'mixed' END qt, event_type = 'purchase' nohit, event_id FROM events), lq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts DESC, line_no) k FROM l) WHERE k = 1)"


@query(f"WITH {_LOG} SELECT line_no, query, ts FROM lq")
def latest_queries(spark, sf_dir):
    return E.latest_queries(A.search_log(spark, sf_dir)).select("line_no", "query", "ts")


@query(f"WITH {_LOG}, c AS (SELECT * FROM lq WHERE query NOT IN ('click 1', 'view 2') AND NOT nohit ORDER BY ts DESC, line_no LIMIT 25) SELECT row_number() OVER (ORDER BY ts, line_no DESC)::INT AS n, query, 'en/src1/doc_' || (event_id % 100) || '.txt' AS expected_path, qt AS expected_query_type, 'seen ' || event_id AS top_observed_snippet FROM c")
def eval_candidates(spark, sf_dir):
    existing = spark.createDataFrame([("click 1",), ("view 2",)], "query string")
    return E.candidates(A.search_log(spark, sf_dir), existing).select("n", "query", F.col("expected_paths")[0].alias("expected_path"), "expected_query_type", "top_observed_snippet")


@query(f"WITH {_LOG}, c AS (SELECT * FROM lq WHERE query NOT IN ('click 1', 'view 2') AND NOT nohit ORDER BY ts DESC, line_no LIMIT 25), d AS (SELECT *, row_number() OVER (ORDER BY ts, line_no DESC) n FROM c) SELECT query FROM d WHERE n IN (1, 2, 5, 6, 7, 8) UNION ALL SELECT unnest(['click 1', 'view 2'])")
def promote(spark, sf_dir):
    existing = spark.createDataFrame([("click 1",), ("view 2",)], "query string")
    found = E.candidates(A.search_log(spark, sf_dir), existing)
    return E.promote(found, existing, E.parse_selections(["1", "2", "8-5", "99"], 25))[0].select("query")


def _ranked_cases(spark, sf_dir):
    return E.case_ranks(A.eval_cases(spark, sf_dir), Q.search(A.searches(spark, sf_dir), A.notes(spark, sf_dir), A.chunks(spark, sf_dir)))


@query(
    f"WITH {X.SEARCH_ROWS}, {X.NOTES}, w AS (SELECT query_id, query, lower(list_extract(string_split(query, ' '), -1)) word FROM q0), f AS (SELECT query_id, list_slice(list_sort(list(rel_path)), 1, 10) p FROM w JOIN notes ON contains(lower(text), word) OR contains(lower(rel_path), word) GROUP BY query_id) "
    "SELECT query_id, query, array_to_string(coalesce(p, []), ' ') AS paths, CASE WHEN query_id % 2 = 0 THEN word ELSE '' END AS terms, CASE WHEN query_id % 2 = 0 THEN 'snippet_focus' END AS expected_query_type FROM w LEFT JOIN f USING (query_id)"
)
def eval_cases_load(spark, sf_dir):
    """The cases, written as a file and read back by the strict reader; those that expect no note are no cases and take no part in the file."""
    every = A.eval_cases(spark, sf_dir)
    path = f"{new_path(spark, 'cases')}/cases.json"
    jsonl.write_cases(every.where(F.size("expected_paths") > 0).select("query", "expected_paths", "expected_snippet_terms", "expected_query_type", F.lit(None).cast("string").alias("notes")), path)
    read = jsonl.read_cases(spark, path).join(every.select("query_id", "query"), "query")
    return read.unionByName(every.where(F.size("expected_paths") == 0), allowMissingColumns=True).select("query_id", "query", F.array_join("expected_paths", " ").alias("paths"), F.array_join("expected_snippet_terms", " ").alias("terms"), "expected_query_type")


_RANKS = (
    f"WITH hits AS ({ORACLE_SQL['search_ranked']}), cases AS ({ORACLE_SQL['eval_cases_load']}), x AS (SELECT c.query_id, c.terms, c.paths, c.expected_query_type, h.rank, h.query_type, list_contains(string_split(c.paths, ' '), h.rel_path) hit, "
    f"c.terms <> '' AND contains({X.norm('h.snippet')}, c.terms) termed FROM cases c LEFT JOIN hits h USING (query_id)), "
    "r AS (SELECT query_id, min(CASE WHEN hit THEN rank END) rank, min(CASE WHEN hit AND termed THEN rank END) snippet_rank, max(query_type) query_type, max(expected_query_type) expected, max(terms) terms FROM x GROUP BY query_id) "
)


@query(_RANKS + "SELECT query_id, rank, snippet_rank, query_type FROM r")
def eval_ranks(spark, sf_dir):
    return _ranked_cases(spark, sf_dir).select("query_id", "rank", "snippet_rank", "query_type")


@query(
    _RANKS + "SELECT count(*) AS cases, count(*) FILTER (rank = 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 8) AS hit_limit, count(expected) AS typed, count(*) FILTER (expected = query_type) AS type_hits, "
    "count(*) FILTER (terms <> '') AS snippet_cases, count(*) FILTER (terms <> '' AND snippet_rank = 1) AS snippet_1, count(*) FILTER (terms <> '' AND snippet_rank <= 3) AS snippet_3, count(*) FILTER (terms <> '' AND snippet_rank <= 8) AS snippet_limit FROM r"
)
def eval_metrics(spark, sf_dir):
    return E.rates(_ranked_cases(spark, sf_dir))


@query()
def answers_batch(spark, sf_dir):
    """Every search answered from its packed sources, in two rounds; the model here quotes the first source. (No SQL: see the unit tests.)"""
    return G.answers(A.searches(spark, sf_dir, embedded=False), _packed(spark, sf_dir), A.quoting_model).select("query_id", "ok", "answer", "rounds")


@query(f"WITH {_LOG} SELECT query, count(*) AS searches, count(*) FILTER (nohit) AS without_hit FROM l GROUP BY query")
def search_log(spark, sf_dir):
    """The log written as JSON lines and read back, searches without a hit included."""
    path = new_path(spark, "log")
    jsonl.append(A.search_log(spark, sf_dir).drop("line_no"), path)
    return jsonl.read_log(spark, path).groupBy("query").agg(F.count(F.lit(1)).alias("searches"), F.count(F.when(F.size("top_hits") == 0, 1)).alias("without_hit"))


@query("SELECT conv_id, turn, role, text AS content FROM conversations")
def chat_history(spark, sf_dir):
    """Every turn appended to a history of its own lines and read back, in order."""
    path = new_path(spark, "history")
    jsonl.append_turns(A.table(spark, sf_dir, "conversations").select("role", F.col("text").alias("content"), F.col("conv_id").cast("double").alias("ts"), F.col("turn").alias("place")), path)
    return jsonl.read_history(spark, path).select(F.col("ts").cast("long").alias("conv_id"), F.col("place").alias("turn"), "role", "content")
