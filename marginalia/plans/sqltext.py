"""DuckDB SQL fragments for the functions of marginalia.functions, used by the oracle queries."""

from __future__ import annotations

from marginalia.functions import words
from marginalia.plans.testdata import SEARCHES


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9'']+'), lambda t: lower(t)), lambda t: length(t) >= 3)"


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def grams(k: int) -> str:
    return f"CASE WHEN len(toks) >= {k} THEN list_transform(range(1, len(toks) - {k} + 2), lambda i: array_to_string(list_slice(toks, i, i + {k} - 1), ' ')) ELSE [] END"


def has_any(low: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({low}, {quote(p)})" for p in phrases) + ")"


def kind(x: str) -> str:
    return f"CASE WHEN {has_any(f'lower({x})', words.FILENAME_PHRASES)} THEN 'filename_focus' WHEN {has_any(f'lower({x})', words.SNIPPET_PHRASES)} THEN 'snippet_focus' ELSE 'mixed' END"


def terms(x: str) -> str:
    wrap = "\"''`()\\[\\]{}<>.,;:!?"
    return f"list_transform(list_filter(list_transform(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda t: regexp_replace(t, '^[{wrap}]+|[{wrap}]+$', '', 'g')), lambda t: length(t) >= 4 AND regexp_matches(t, '[./_-]')), lambda t: lower(t))"


def features(source: str) -> str:
    """CTE q with the features of the rows of source (query_id, query)."""
    keep = f"list_filter(all_tokens, lambda t: NOT list_contains({names(words.LOW_SIGNAL)}, t))"
    return (
        f"q1 AS (SELECT *, {tokens('query')} all_tokens FROM {source}), q2 AS (SELECT *, CASE WHEN len({keep}) = 0 THEN all_tokens ELSE {keep} END toks FROM q1), "
        f"q AS (SELECT *, array_to_string(toks, ' ') phrase, {grams(4)} g4, {grams(3)} g3, {grams(2)} g2, {terms('query')} terms, {kind('query')} kind FROM q2)"
    )


SEARCH_ROWS = "q0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {quote(q)})" for i, q in enumerate(SEARCHES)) + ") v(query_id, query))"
NOTES = "notes AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' rel_path, doc_id, text, 1700000000.0::DOUBLE + doc_id * 60 mtime, octet_length(encode(text)) size FROM documents)"


def lines(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] WHEN suffix({x}, chr(10)) THEN string_split(substr({x}, 1, length({x}) - 1), chr(10)) ELSE string_split({x}, chr(10)) END"


def keyword(q: str, d: str) -> str:
    n = lambda a: f"len(list_filter({a}, lambda y: y = t))"
    return f"CASE WHEN len({q}) = 0 OR len({d}) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct({q}), lambda t: least({n(q)}, {n(d)}))), 0)::DOUBLE / len({q}) END"


def text_match(phrase: str, q: str, low: str, d: str) -> str:
    return f"CASE WHEN {phrase} = '' OR {low} = '' THEN 0.0 WHEN contains({low}, {phrase}) THEN 1.0 ELSE len(list_intersect(list_distinct({q}), list_distinct({d})))::DOUBLE / greatest(len(list_distinct({q})), 1) END"


def phrase_match(q: str, n: str) -> str:
    some = lambda g: f"len(list_filter({q}.{g}, lambda y: contains({n}, y))) > 0"
    return f"CASE WHEN {q}.phrase = '' OR {n} = '' THEN 0.0 WHEN contains({n}, {q}.phrase) THEN 1.0 WHEN {some('g4')} THEN 0.9 WHEN {some('g3')} THEN 0.78 WHEN {some('g2')} THEN 0.62 ELSE 0.0 END::DOUBLE"


def ordered(q: str, n: str) -> str:
    at = f"(CASE WHEN a.stop THEN 0 ELSE instr(substr({n}, a.pos), x.t) END)"
    step = f"{{'t': x.t, 'pos': CASE WHEN {at} > 0 THEN a.pos + {at} - 1 + length(x.t) ELSE a.pos END, 'n': a.n + CASE WHEN {at} > 0 THEN 1 ELSE 0 END, 'stop': {at} = 0}}"
    start = "{'t': '', 'pos': 1::BIGINT, 'n': 0::BIGINT, 'stop': false}"
    return f"CASE WHEN len({q}) = 0 OR {n} = '' THEN 0.0 ELSE (list_reduce(list_prepend({start}, list_transform({q}, lambda t: {{'t': t, 'pos': 1::BIGINT, 'n': 0::BIGINT, 'stop': false}})), lambda a, x: {step})).n::DOUBLE / len({q}) END"


def literal(t: str, low: str) -> str:
    return f"CASE WHEN len({t}) = 0 OR {low} = '' THEN 0.0 ELSE len(list_filter({t}, lambda y: contains({low}, y)))::DOUBLE / len({t}) END"


def basename(p: str) -> str:
    return f"list_extract(string_split({p}, '/'), -1)"


def stem(p: str) -> str:
    return f"regexp_replace({basename(p)}, '(.)\\.[^.]+$', '\\1')"


def filename(q: str, p: str) -> str:
    """p: a path. As filename_match."""
    st, low = f"lower({stem(p)})", f"lower({p})"
    T, Q, P = tokens(st), f"list_distinct({q}.toks)", f"list_distinct({tokens(f'translate({p}, chr(47), chr(32))')})"
    n, common, shared = f"len({Q})", f"len(list_intersect({Q}, {P}))", f"len(list_intersect({Q}, list_distinct({T})))"
    overlap, spec = f"({common}::DOUBLE / greatest({n}, 1))", f"({common}::DOUBLE / greatest(len({P}), 1))"
    compact = f"(1 - least(greatest(0, len({T}) - {n}), 6) / 6.0::DOUBLE)"
    brief = f"(1 - least(length({st}), 80) / 80.0::DOUBLE)"
    spaced = f"(CASE WHEN contains({st}, ' ') THEN 0.05 ELSE 0 END)::DOUBLE"
    pen = f"((CASE WHEN contains({st}, '.') THEN 0.06 ELSE 0 END) + (CASE WHEN len(list_intersect({T}, {names(words.ARTIFACTS)})) > 0 THEN 0.08 ELSE 0 END))::DOUBLE"
    clamp = lambda m, v: f"greatest(0.0::DOUBLE, least({m}::DOUBLE, {v} - {pen}))"
    exact = f"regexp_matches({st}, '(^|[^a-z0-9])' || regexp_escape({q}.phrase) || '($|[^a-z0-9])')"
    return (
        f"CASE WHEN {q}.phrase = '' OR {n} = 0 OR len({P}) = 0 THEN 0.0 WHEN {st} = {q}.phrase THEN {clamp(1.0, '0.995::DOUBLE')} "
        f"WHEN {exact} THEN {clamp(0.99, f'(0.74 + 0.08 * {compact} + 0.08 * {brief} + {spaced} + (CASE WHEN {shared} = {n} AND len(list_distinct({T})) = {n} THEN 0.03 ELSE 0 END) + (CASE WHEN {shared} = {n} THEN 0.02 ELSE 0 END))')} "
        f"WHEN contains({st}, {q}.phrase) OR contains({low}, {q}.phrase) THEN {clamp(0.90, f'(0.68 + 0.10 * {overlap} + 0.10 * {spec} + 0.08 * {brief} + 0.04 * {compact} + {spaced})')} "
        f"ELSE {clamp(0.85, f'(0.58 * {overlap} + 0.24 * {spec} + 0.18 * {compact} + {spaced})')} END"
    )


def snippet(x: str, most: int = 220) -> str:
    c = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({c}) > {most} THEN rtrim(substr({c}, 1, {most - 3})) || '...' ELSE {c} END"


def metadata_text(p: str, heading: str, first: str) -> str:
    return f"trim(concat_ws(' ', nullif({basename(p)}, ''), nullif({stem(p)}, ''), nullif({heading}, ''), nullif({first}, '')))"


def weighted(kind: str, s: dict) -> str:
    one = lambda w: "(" + " + ".join(f"{w[k]} * {s[k]}" for k in ("semantic", "keyword", "filename", "text", "metadata", "phrase")) + ")"
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {one(w)}" for k, w in words.WEIGHTS.items()) + " END"
