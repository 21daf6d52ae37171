"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Symbols. Letters are lower-cased; every run of other characters is one blank. Each text starts with ORDER - 1 boundary symbols.

Models. Each language has an interpolated Kneser-Ney model of ORDER characters: counts at the highest order, continuation counts below,
one absolute discount n1 / (n1 + 2 n2) an order, and the uniform distribution at the end. All languages share one sorted array of 64-bit n-gram hashes for
each order, with a row of log probabilities (one a language, completed by back-off where a language has not seen the n-gram), and one of
context hashes with rows of back-off weights. The hash is a sum of mixed code points, each times an odd number of its place, so every letter of every
script is a symbol of its own. A position is looked up at the highest order first; only misses go on to the next.

Decision. The language of least cross-entropy for each character; of equal ones the first by name. The score is its share of a softmax of the log
likelihoods, at a temperature fitted on labelled texts kept out of the counts. On the same texts the middle cross-entropy of each language and its
scatter (between texts, and by length within) are measured by medians; a text whose cross-entropy exceeds the middle of its language by REJECT_Z such
deviations (or by half as much again as the 99th percentile of the texts measured, if that is more) is rejected, as is a text without letters.

Training rows are a documented sample: of each language at most ROWS_PER_LANGUAGE labelled rows, those of least hash of their id, up to
BYTES_PER_LANGUAGE of text (less if there are so many languages that they would pass SAMPLE_BYTES together); a larger text is not drawn. No language is left out.
Every text is scored whole, in pieces of PIECE symbols that carry their context along.

Edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; with no labelled row at all every text is
`und`; characters no model has seen share one symbol; repeated rows are scored each. Columns of the input with the names of results give way to them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import giving_way, handing_back

ORDER = 5
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE, SAMPLE_BYTES = 500, 4 << 20, 256 << 20
PIECE = 1 << 18
#: Rows whose texts are Python's objects at a time, and symbols that are looked up together: what a worker takes, and keeps when it idles, follows them.
SLICE, LOOKED_UP = 256, 1 << 16
REJECT_Z = 12.0
#: Every CALIBRATE-th row of the sample is kept out of the counts.
CALIBRATE = 5
#: Symbols that are no letters; a letter's symbol is its code point, which is larger.
BOUNDARY, BLANK, UNSEEN = 1, 2, 3
UND = "und"
#: One odd multiplier for each place of an n-gram: the powers of one.
MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, ORDER + 1)]


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters with single zeros for what is between, around them too; empty if there is no letter."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not x.any():
        return x[:0]
    x = np.concatenate([[0], x, [0]]).astype(np.uint32)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each symbol."""
    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(0xA5A5A5A5)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(x: np.ndarray) -> list[np.ndarray]:
    """By order: the hash of the n-gram that ends at each place (from place n - 1 on); of order 0 all zeros."""
    mixed, out = _mixed(x), [np.zeros(len(x), dtype=np.uint64)]
    for n in range(1, ORDER + 1):
        h = out[-1].copy()
        h[n - 1 :] += mixed[: len(x) - n + 1] * MULTIPLIERS[n - 1]
        out.append(h)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # sorted code points
    grams: list[np.ndarray]  # by order - 1: sorted hashes
    gram_logs: list[np.ndarray]
    contexts: list[np.ndarray]  # by context length - 1
    context_logs: list[np.ndarray]
    temperature: float = 1.0
    mean: np.ndarray | None = None
    between: np.ndarray | None = None  # variance of a text's cross-entropy, whatever its length
    within: np.ndarray | None = None  # variance of one symbol's
    reject_z: np.ndarray | None = None

    def symbols(self, letters: np.ndarray) -> np.ndarray:
        out = np.where(_find(self.alphabet, letters)[1], letters, UNSEEN).astype(np.uint64)
        out[letters == 0] = BLANK
        return out

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """(len(x) - ORDER + 1, languages) log probabilities of the symbols from place ORDER - 1 on."""
        first = ORDER - 1
        out = np.zeros((max(0, len(x) - first), len(self.languages)), dtype=np.float32)
        left, own = np.arange(first, first + len(out)), _hashes(x)
        for n in range(ORDER, 0, -1):
            at, hit = _find(self.grams[n - 1], own[n][left])
            out[left[hit] - first] += self.gram_logs[n - 1][at[hit]]
            left = left[~hit]
            if n == 1 or not len(left):
                break
            at, hit = _find(self.contexts[n - 2], own[n - 1][left - 1])
            out[left[hit] - first] += self.context_logs[n - 2][at[hit]]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods (texts, languages), symbols in each text; 0: no letter)."""
        logs, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        lead, batch, where, held = np.full(ORDER - 1, BOUNDARY, dtype=np.uint64), [], [], 0

        def flush() -> None:
            x = np.concatenate(batch)
            p = self.log_probs(x)
            ends = np.cumsum([len(b) for b in batch])
            starts = np.concatenate([[0], ends[:-1]])
            for i, s, e in zip(where, starts.tolist(), ends.tolist()):
                # the row of place k is k - ORDER + 1; a piece starts with ORDER - 1 places of context
                logs[i] += p[s : e - ORDER + 1].sum(axis=0, dtype=np.float64)
            batch.clear(), where.clear()

        for i, text in enumerate(texts):
            x = self.symbols(letters_of(text))
            sizes[i] = len(x)
            if not len(x):
                continue
            x = np.concatenate([lead, x])
            for at in range(0, len(x) - ORDER + 1, PIECE):
                batch.append(x[at : at + PIECE + ORDER - 1]), where.append(i)
                held += len(batch[-1])
                if held >= LOOKED_UP:
                    flush()
                    held = 0
        if batch:
            flush()
        return logs, sizes

    def decide(self, logs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, cross-entropy, rejected); meaningless where sizes is 0."""
        n = np.maximum(sizes, 1)
        cross = -logs / n[:, None]
        best = cross.argmin(axis=1)
        rows = np.arange(len(best))
        scaled = logs * self.temperature
        share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        least = cross[rows, best]
        z = (least - self.mean[best]) / np.sqrt(self.between[best] + self.within[best] / n)
        return best, share[rows, best], least, (z > self.reject_z[best]) | (sizes == 0)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sum of values, number of rows)."""
    distinct, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, np.bincount(inverse, weights=values, minlength=len(distinct)), count


def _count(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order - 1: of each n-gram hash, counts (continuation counts below the highest order), and the hashes of its context and of its suffix. x: texts with their boundaries."""
    own, at = _hashes(x), np.nonzero(x != BOUNDARY)[0]
    out = []
    for n in range(ORDER, 0, -1):
        grams, first, count = np.unique(own[n][at], return_index=True, return_counts=True)
        # Of each n-gram one place goes on, so the next order counts how many kinds end in it.
        at = at[first]
        out.append((grams, count, own[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64), own[n - 1][at]))
    return out[::-1]


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text), in an order that does not depend on the language. Models, temperature and rejection limits."""
    rows = [(lang, x) for lang, text in rows if len(x := letters_of(text))]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.empty(0, np.uint32), [], [], [], [])
    seen: dict[str, int] = {}
    fit, held = [], []
    for lang, x in rows:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % CALIBRATE == 0 else fit).append((lang, x))
    codes = np.unique(np.concatenate([x for _, x in fit])) if fit else np.empty(0, np.uint32)
    model = Model(languages, codes[codes != 0], [], [], [], [])
    alphabet = np.concatenate([[BOUNDARY, BLANK, UNSEEN], model.alphabet]).astype(np.uint64)
    lead = np.full(ORDER - 1, BOUNDARY, dtype=np.uint64)
    counts = [_count(np.concatenate([z for g, x in fit if g == lang for z in (lead, model.symbols(x))] or [lead])) for lang in languages]
    lower = np.full((1, len(languages)), 1.0 / len(alphabet))  # the uniform distribution, for every symbol
    lower_keys = np.zeros(1, dtype=np.uint64)
    for n in range(1, ORDER + 1):
        alone = _mixed(alphabet) * MULTIPLIERS[0] if n == 1 else np.empty(0, np.uint64)
        every, context, suffix = (np.concatenate([c[n - 1][k] for c in counts] + [alone if k == 0 else np.zeros_like(alone)]) for k in (0, 2, 3))
        grams, first = np.unique(every, return_index=True)
        context, suffix = context[first], suffix[first]
        back = np.unique(np.concatenate([c[n - 1][2] for c in counts]))
        gamma = np.ones((len(back), len(languages)))
        prob = lower[_find(lower_keys, suffix)[0]].copy()
        for k, c in enumerate(counts):
            own, a, before, _ = c[n - 1]
            if not len(own):
                continue
            n1, n2 = (a == 1).sum(), (a == 2).sum()
            discount = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
            ctx, total, kinds = _grouped(before, a)
            gamma[_find(back, ctx)[0], k] = discount * kinds / total
            at, there = _find(ctx, context)
            prob[there, k] *= (discount * kinds / total)[at[there]]
            prob[_find(grams, own)[0], k] += (a - discount) / total[_find(ctx, before)[0]]
        model.grams.append(grams), model.gram_logs.append(np.log(prob).astype(np.float32))
        if n > 1:
            model.contexts.append(back), model.context_logs.append(np.log(gamma).astype(np.float32))
        lower, lower_keys = prob, grams
    _calibrate(model, held or fit)
    return model


def _calibrate(model: Model, held: list[tuple[str, np.ndarray]]) -> None:
    k = len(model.languages)
    model.mean, model.between, model.within, model.reject_z = np.full(k, 3.0), np.full(k, 0.04), np.full(k, 6.0), np.full(k, REJECT_Z)
    if not held:
        return
    lead = np.full(ORDER - 1, BOUNDARY, dtype=np.uint64)
    own, sizes, logs, inner = np.array([model.languages.index(g) for g, _ in held]), [], [], []
    for g, x in held:
        p = model.log_probs(np.concatenate([lead, model.symbols(x)])).astype(np.float64)
        sizes.append(len(p)), logs.append(p.sum(axis=0)), inner.append(p[:, model.languages.index(g)].var())
    sizes, logs, inner = np.array(sizes), np.array(logs), np.array(inner)
    cross = -logs[np.arange(len(own)), own] / sizes
    for i in range(k):
        if (mine := own == i).any():
            # By medians, so that a few texts with a wrong label do not widen what is taken for the language.
            model.within[i] = max(1.0, float(np.median(inner[mine])))
            model.mean[i] = np.median(cross[mine])
            model.between[i] = max(0.01, float(np.median((cross[mine] - model.mean[i]) ** 2)) / 0.455 - model.within[i] / float(np.median(sizes[mine])))
            z = (cross[mine] - model.mean[i]) / np.sqrt(model.between[i] + model.within[i] / sizes[mine])
            model.reject_z[i] = max(REJECT_Z, 1.5 * float(np.quantile(z, 0.99)))

    def loss(t: float) -> float:
        s = logs * t
        return float(np.mean(np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(own)), own]))

    model.temperature = min((2.0**-e for e in range(0, 10)), key=loss)


def training_rows(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, size: int = BYTES_PER_LANGUAGE, most: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """labelled: doc_id, text, lang. Of each language at most `rows` rows and `size` bytes, those of least hash of their id, in its order."""
    known = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    languages = known.select("lang").distinct().count()
    room = min(size, most // max(1, languages))
    # Chosen without their texts; each task passes on at most `rows` rows of a language.
    narrow = known.select("doc_id", "lang", "h", F.octet_length("text").alias("bytes"), F.xxhash64(F.lit("language"), F.col("doc_id")).alias("draw")).where(F.col("bytes") <= room)
    by = Window.partitionBy("lang").orderBy("draw", "doc_id", "h")
    first = narrow.withColumn("k", F.row_number().over(by)).where(F.col("k") <= rows)
    first = first.withColumn("upto", F.sum("bytes").over(Window.partitionBy("lang").orderBy("k"))).where(F.col("upto") <= room)
    first = first.groupBy(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("draw"))
    # At most `rows` rows a language, by the choice above.
    found = known.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h")))
    found = found.groupBy("_id", "lang", "h").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("draw").alias("draw")).collect()
    return [(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["draw"], str(r["_id"]), r["text"])) for _ in range(r["n"])]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """The model of the documents that are not held out. docs: doc_id, text, lang."""
    return train(training_rows(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), rows))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and lang_pred, score, cross_entropy (null if und), rejected. Only text is looked at.

    Columns of docs with the names of results give way to them.
    """
    docs = giving_way(docs, "lang_pred", "score", "cross_entropy", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    names = [f"k{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    renamed = docs.toDF(*names)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema), "lang_pred string", "score double", "cross_entropy double", "rejected boolean"])

    @handing_back
    def run(batches):
        m = shared.value
        for batch in (b.slice(first, SLICE) for b in batches for first in range(0, b.num_rows, SLICE)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if m.languages:
                logs, sizes = m.score(texts)
                best, score, cross, out = m.decide(logs, sizes)
            else:
                sizes = np.zeros(len(texts), np.int64)
                best, score, cross, out = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            none = sizes == 0
            cols = [
                pa.array([UND if n else m.languages[b] for b, n in zip(best.tolist(), none.tolist())], pa.string()),
                pa.array(np.where(none, 0.0, score), pa.float64()), pa.array(cross, pa.float64(), mask=none), pa.array(out | none, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, "lang_pred", "score", "cross_entropy", "rejected"])

    out = renamed.mapInArrow(run, schema)
    return out.toDF(*docs.columns, "lang_pred", "score", "cross_entropy", "rejected")
