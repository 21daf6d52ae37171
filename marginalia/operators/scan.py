"""The lines of notes that can score at all for one batch of queries, found in one pass over the texts, without an index.

An inverted index (postings.py) pays for many batches; for one it costs many times its input in writes. Here the batch is what is looked up: its tokens go to
every task, words of lines are matched with them batch by batch of lines, and nothing is dealt out or written. The conditions are those of postings.py, whose
notes say why each is necessary; frequencies, which only decide what is looked up, are those of the lines at hand.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.functions.columns import bound
from marginalia.operators.postings import LEAST, LEFT_OUT, RUN, line_rows

#: Cells (a line and a query) that are counted at a time, and words of which a task remembers what they hold.
CELLS, REMEMBERED = 1 << 22, 500_000
#: Lines that are matched at a time.
LINES = 5000
#: Letters outside ASCII that lower-casing turns into ASCII ones: only lines with them have tokens that are no words of the lower-cased line.
TURNING = ("\u0130", "\u212a")


def _lists(pairs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (key, value), keys below n, as (where each key's values begin, values)."""
    pairs = sorted(set(pairs))
    keys = np.array([k for k, _ in pairs], np.int64)
    return np.searchsorted(keys, np.arange(n + 1)), np.array([v for _, v in pairs], np.int64)


def _expanded(lists: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, value) for all values of each key."""
    starts, values = lists
    size = starts[keys + 1] - starts[keys]
    ends = np.cumsum(size)
    at = np.repeat(starts[keys] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    return np.repeat(np.arange(len(keys)), size), values[at]


@dataclass
class Batch:
    """A batch of queries: of each its tokens in order, and the word runs of its terms."""

    tokens: list[list[str]]
    runs: list[list[str]]
    words: dict[str, tuple] = field(default_factory=dict)

    def __post_init__(self):
        self.number = {t: i for i, t in enumerate(sorted({t for x in (*self.tokens, *self.runs) for t in x}))}
        self.lengths = sorted({len(t) for t in self.number})
        n, q = max(1, len(self.number)), range(len(self.tokens))
        no = [[self.number[t] for t in x] for x in self.tokens]
        self.weights = [Counter(x) for x in no]
        self.lead = [sorted(set(x[: math.ceil(len(x) * LEAST / 100)])) for x in no]
        # Any place of these, inside a word, makes a line a candidate: phrases of one token, and terms.
        self.sure = _lists([*((x[0], i) for i, x in zip(q, no) if len(x) == 1), *((self.number[t], i) for i, x in zip(q, self.runs) for t in x)], n)
        two = sorted({(a * n + b, i) for i, x in zip(q, no) for a, b in zip(x, x[1:])})
        self.codes = np.unique(np.array([c for c, _ in two], np.int64))
        self.two = _lists([(int(np.searchsorted(self.codes, c)), i) for c, i in two], len(self.codes))
        self.n = n
        own = sorted((t * len(no) + i, k) for i, x in enumerate(self.weights) for t, k in x.items())
        self.weighed, self.weight = np.array([c for c, _ in own], np.int64), np.array([k for _, k in own], np.int64)

    def held(self, word: str) -> tuple:
        """(tokens that the word contains, those it begins with, those it ends with, itself if it is one)."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            found = {(a, k, self.number[t]) for k in self.lengths if k <= len(word) for a in range(len(word) - k + 1) if (t := word[a : a + k]) in self.number}
            inside, first, last = (tuple({t for a, k, t in found if keep(a, k)}) for keep in (lambda a, k: True, lambda a, k: a == 0, lambda a, k: a + k == len(word)))
            known = self.words[word] = (inside, first, last, (self.number[word],) if word in self.number else ())
        return known

    def _left_out(self, often: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(token, query) of all that is looked up; and of each query what a line must have of it, by weight and by distinct tokens."""
        asked, need, need_distinct = [], [], []
        for i, weights in enumerate(self.weights):
            n, w, k, by = sum(weights.values()), 0, 0, sorted(weights, key=lambda t: (-often[t], t))
            for t in by:
                if 100 * (w + weights[t]) <= LEFT_OUT * n and 100 * (k + 1) <= LEFT_OUT * len(by):
                    w, k = w + weights[t], k + 1
                else:
                    asked.append((t, i))
            need.append(LEAST * n - 100 * w - 1), need_distinct.append(LEAST * len(by) - 100 * k - 1)
        return asked, np.array(need), np.array(need_distinct)

    def candidates(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """words: of each line its words in order, and others, parted from them and at the end by an empty one. (line, query) of those that may reach LEAST."""
        flat = words.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        size = words.value_lengths().to_numpy()
        line = np.repeat(np.arange(len(size)), size)
        held = [self.held(w) for w in flat.dictionary.to_pylist()]
        inside, first, last, own = ([(w, t) for w, h in enumerate(held) for t in h[k]] for k in range(4))
        n, q = self.n, len(self.tokens)
        inside, first, last, own = (_lists(x, len(held)) for x in (inside, first, last, own))

        def places(lists) -> tuple[np.ndarray, np.ndarray]:
            """(line, token), once each."""
            at, token = _expanded(lists, code)
            both = np.unique(line[at] * n + token)
            return both // n, both % n

        whole, part = places(own), places(inside)
        asked, need, need_distinct = self._left_out(np.bincount(whole[1], minlength=n))
        rare = np.bincount(part[1], minlength=n)
        two = [sorted(x, key=lambda t: (rare[t], t))[:2] for x in self.lead]
        ends = [_lists([(x[-1 if k else 0], i) for i, x in enumerate(two) if x], n) for k in (0, 1)]
        asked = _lists(asked, n)

        # Consecutive words, of which one ends with a token and the next begins with the one that follows it in a query.
        a, one = _expanded(last, code[:-1])
        b, nxt = _expanded(first, code[a + 1])
        pair = one[b] * n + nxt
        k = np.minimum(np.searchsorted(self.codes, pair), max(0, len(self.codes) - 1))
        there = self.codes[k] == pair if len(self.codes) else np.zeros(len(pair), bool)
        c, by_pair = _expanded(self.two, k[there])
        sure = [(line[a[b[there][c]]], by_pair)]
        at, query = _expanded(self.sure, part[1])
        sure.append((part[0][at], query))

        found = []
        step = max(1, CELLS // max(1, q))
        for start in range(0, len(size), step):
            stop = min(len(size), start + step)
            cells = (stop - start) * q

            def within(lines: np.ndarray, queries: np.ndarray) -> np.ndarray:
                keep = (lines >= start) & (lines < stop)
                return (lines[keep] - start) * q + queries[keep]

            def cut(x, lists):
                lo, hi = np.searchsorted(x[0], [start, stop])
                at, query = _expanded(lists, x[1][lo:hi])
                return (x[0][lo:hi][at] - start) * q + query, x[1][lo:hi][at], query

            cell, token, query = cut(whole, asked)
            w = self.weight[np.searchsorted(self.weighed, token * q + query)]
            total, distinct = np.bincount(cell, weights=w, minlength=cells), np.bincount(cell, minlength=cells)
            ok = (distinct > 0) & ((100 * total >= np.tile(need, stop - start)) | (100 * distinct >= np.tile(need_distinct, stop - start)))
            bits = []
            for lists in ends:
                bit = np.zeros(cells, bool)
                bit[cut(part, lists)[0]] = True
                bits.append(bit)
            ok |= bits[0] & bits[1]
            for x in sure:
                ok[within(*x)] = True
            hit = np.flatnonzero(ok)
            found.append((hit // q + start, hit % q))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _words(content: Column) -> Column:
    """The words of a line as postings.py files them, with an empty one at the end; tokens that are no such words come after it, each with an empty one."""
    words = F.regexp_extract_all(F.lower(content), F.lit(RUN), F.lit(0))
    rest = F.flatten(F.transform(F.array_except(T.tokens(content), words), lambda t: F.array(t, F.lit(""))))
    turning = content.contains(TURNING[0]) | content.contains(TURNING[1])
    return F.concat(words, F.array(F.lit("")), F.when(turning, rest).otherwise(F.array().cast("array<string>")))


def candidate_lines(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """notes: rel_path, text. queries: query_id, q (features), a batch of user input. query_id, rel_path, line, content, d (features of content) and quality of every line that may reach LEAST.

    What is computed of a line is computed once for all queries that may find it.
    """
    rows = queries.select("query_id", F.col("q")["toks"].alias("toks"), F.col("q")["terms"].alias("terms")).collect()
    ids = [r.query_id for r in rows]
    longest = lambda term: max(_runs(term), key=lambda r: (len(r), r), default="")
    runs = [[longest(t) for t in r.terms] for r in rows]
    shared = notes.sparkSession.sparkContext.broadcast(([list(r.toks) for r in rows], [[t for t in x if len(t) >= 3] for x in runs]))
    lines = line_rows(notes.select("rel_path", "text"))

    def run(batches):
        own = Batch(*shared.value)
        for rows in batches:
            for at in range(0, rows.num_rows, LINES):
                part = rows.slice(at, LINES)
                line, query = own.candidates(part.column("words"))
                order = np.lexsort((query, line))
                line, first = np.unique(line[order], return_index=True)
                by_line = pa.array([ids[i] for i in query[order].tolist()], pa.int64())
                queries_of = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), by_line)
                taken = [part.column(c).take(pa.array(line)) for c in ("rel_path", "line", "content")]
                yield pa.RecordBatch.from_arrays([queries_of, *taken], ["query_ids", "rel_path", "line", "content"])

    out = lines.withColumn("words", _words(F.col("content"))).mapInArrow(run, "query_ids array<long>, rel_path string, line int, content string")
    # Terms without a run of three word characters have no words to look up: lines are searched for them. A line that is found twice does no harm.
    odd = [(r.query_id, t) for r, x in zip(rows, runs) for t, run_ in zip(r.terms, x) if len(run_) < 3]
    if odd:
        terms = notes.sparkSession.createDataFrame(odd, "query_id long, term string")
        out = out.unionByName(lines.join(F.broadcast(terms), F.contains(F.lower("content"), F.col("term"))).select(F.array("query_id").alias("query_ids"), "rel_path", "line", "content"))
    out = bound(out, d=S.text_features(F.col("content")))
    out = bound(out, quality=S.line_quality(F.col("content"), F.col("d")["tokens"], F.col("d")["norm"]))
    return out.select(F.explode("query_ids").alias("query_id"), "rel_path", "line", "content", "d", "quality")


def _runs(term: str) -> list[str]:
    return re.findall(RUN, term)
