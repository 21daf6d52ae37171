"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints. The shingles of a text (repeats included) are hashed by XXH64; a bit of the 64-bit fingerprint is set if it is set in more
than half of the hashes.

Search. A fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the Golay code (golay.py), whose keys are
shared by words up to two bits apart. Of at most four differing bits, either each segment has at most two, and the fingerprints share a
key in every segment; or one segment has three or four, and of the other two one is equal and the other differs in at most
one bit, so they share the equal bits and a key. So each fingerprint is filed under its triples of keys and under its (equal
segment, key of another) pairs: at most 216 + 36 keys of 34 to 36 bits. No link can be missed.

Verification. Distinct fingerprints only are filed. Rows are dealt out by key and read in key order; each run of one key is verified in
blocks of BLOCK fingerprints, and of what is within reach only a spanning forest is kept, so a bucket of b
fingerprints yields fewer than b links, never b squared rows. A fingerprint in a bucket of more than LARGE is also filed, once, under all
words within two bits of it: fingerprints within four bits have such a word in common, and all under one word are within four bits of
each other, so each is simply linked to the least. That is linear in the bucket, exact, and lets the large buckets be skipped.

Components of the links are found by components.py, on fingerprints, and carried to the documents by a join.

Edge cases: a null text counts as empty; texts without a word have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle of them all; rows with equal texts fall together; a null doc_id is the smallest only where a
component holds no other; very long texts are hashed whole; an empty table gives no rows. Other columns pass through; those named fp, component_id or
root give way to the results (keep_one returns all columns as they were).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import golay, shingle_join
from marginalia.llm.common import giving_way, handing_back, materialize, passing, row_key, set_apart
from marginalia.llm.components import components

SHINGLE, SEED, REACH = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCK, LARGE = 2048, 8192


def shingle_hashes(text: str, width: int = SHINGLE, distinct: bool = False) -> list[int]:
    """XXH64 of each shingle (or each distinct one) of the lower-cased words; bytes.lower and bytes.split treat ASCII only."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    if width == 1:
        return [h(w, SEED) for w in (set(words) if distinct else words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1)[: len(words) - width + 1].tolist()
    shingles = [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    return [h(x, SEED) for x in (set(shingles) if distinct else shingles)]


def fingerprint_of(text: str, width: int = SHINGLE, distinct: bool = False) -> int:
    hashes = shingle_hashes(text, width, distinct)
    if not hashes:
        return 0
    half, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        half += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * half > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """All columns of docs but text, and fp (the fingerprint's 64 bits as a long)."""
    docs = giving_way(docs, "fp", "component_id", "root")
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            fp = np.array([fingerprint_of(x or "", width, distinct) for x in t["text"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield from t.select(keep).append_column("fp", pa.array(fp)).to_batches()

    return docs.mapInArrow(run, schema)


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys of an array of uint64 fingerprints."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    key = [golay.keys(s).astype(np.int64) for s in seg]
    index, out = [], []

    def add(ok: np.ndarray, k: np.ndarray) -> None:
        i = np.nonzero(ok.reshape(len(fp), -1))[0]
        index.append(i)
        out.append(k.reshape(len(fp), -1)[ok.reshape(len(fp), -1)])

    a, b, c = key[0][:, :, None, None], key[1][:, None, :, None], key[2][:, None, None, :]
    add((a >= 0) & (b >= 0) & (c >= 0), (a << 24) | (b << 12) | c)
    for i in range(3):
        for j in range(3):
            if i != j:
                add(key[j] >= 0, (np.int64(1 + 3 * i + j) << 40) | (seg[i].astype(np.int64)[:, None] << 12) | key[j])
    return np.concatenate(index), np.concatenate(out)


def _filed(fps: DataFrame) -> DataFrame:
    """key, fp for all bucket keys of a table of distinct fingerprints."""
    @handing_back
    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                index, key = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[index].view(np.int64))], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def _near_words(fps: DataFrame) -> DataFrame:
    """word, fp for all words within two bits."""
    bits = [1 << i for i in range(64)]
    flips = np.array([0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])], dtype=np.uint64)

    @handing_back
    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["word", "fp"])

    return fps.mapInArrow(run, "word long, fp long")


def _large_runs(filed: DataFrame, crowded: DataFrame, reach: int) -> DataFrame:
    """a, b: links of the buckets that hold a crowded fingerprint, each cut into blocks of BLOCK by hash; every pair of blocks is a task of its own."""
    held = filed.join(crowded, "fp").select("key", "fp").distinct()
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    own = held.join(sizes, "key").withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "fp")
    return _runs(dealt, 2**62, reach).select("a", "b")


class _Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def forest(fp: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the links within reach bits among the fingerprints of one bucket."""
    f, out = _Forest(len(fp)), []
    if len(fp) == 2:
        return [(0, 1)] if bin(int(fp[0] ^ fp[1])).count("1") <= reach else []
    for i in range(0, len(fp), BLOCK):
        for j in range(0, i + 1, BLOCK):
            near = np.bitwise_count(fp[i : i + BLOCK, None] ^ fp[None, j : j + BLOCK]) <= reach
            for x in range(len(near)):
                row = np.nonzero(near[x, : x if i == j else None])[0]
                out += [(i + x, j + y) for y in row.tolist() if f.link(i + x, j + y)]
    return out


def _runs(filed: DataFrame, most: int, reach: int) -> DataFrame:
    """filed: key, fp, dealt out by key and sorted. a, b: links of all buckets of at most `most` rows; a bucket beyond gives a row (fp, fp, large) for each of its rows."""
    @handing_back
    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def ended(key, fp):
            left, right, large = [], [], []
            if len(key):
                cut = np.nonzero(np.diff(key))[0] + 1
                start, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(key)]]))
                two = start[size == 2]
                x, y = fp[two], fp[two + 1]
                ok = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= reach
                left.append(x[ok]), right.append(y[ok]), large.append(np.zeros(ok.sum(), bool))
                for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                    part = fp[s : s + n]
                    if n > most:
                        left.append(part), right.append(part), large.append(np.ones(n, bool))
                    elif pairs := forest(part.view(np.uint64), reach):
                        i, j = np.array(pairs).T
                        left.append(part[i]), right.append(part[j]), large.append(np.zeros(len(i), bool))
            a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate(large) if large else np.empty(0, bool))], ["a", "b", "large"])

        for batch in batches:
            key, fp = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([fp, np.asarray(batch.column(1))])
            if len(key) and len(last := np.nonzero(key != key[-1])[0]):
                cut = last[-1] + 1
                yield ended(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield ended(key, fp)

    return filed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, large boolean")


def links(fps: DataFrame, large: int = LARGE, reach: int = REACH) -> DataFrame:
    """fps: distinct fingerprints. a, b: pairs whose components are those of all pairs within REACH bits.

    With a larger reach, pairs of more differing bits are linked too where they share a key, in buckets of any size: three in four of five
    bits, fewer beyond.
    """
    found = materialize(_runs(_filed(fps), large, reach), "links")
    out = found.where("not large").select("a", "b").distinct()
    crowded = found.where("large").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return out
    if reach != REACH:
        return out.union(_large_runs(_filed(fps), crowded, reach).distinct())
    near = _near_words(crowded)
    stars = near.groupBy("word").agg(F.min("fp").alias("b"))
    return out.union(near.join(stars, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, order: str = "doc_id", distinct: bool = False, reach: int = REACH) -> DataFrame:
    """All columns of docs but text, fp, and component_id: the least `order` among the documents reachable by links."""
    own = materialize(fingerprints(docs, width, distinct), "fp")
    by_fp = materialize(own.groupBy("fp").agg(F.min(order).alias("_least")), "distinct")
    roots = components(links(by_fp.select("fp"), reach=reach))
    named = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = named.join(heads, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(*own.columns, "component_id")


def close_pairs(sets: DataFrame) -> DataFrame:
    """sets: sid, fp. a, b: pairs of sids that join all sets whose fingerprints link, by their Golay keys."""
    by_fp = materialize(sets.groupBy("fp").agg(F.min("sid").alias("_first")), "distinct")
    same = sets.join(by_fp, "fp").where("sid <> _first").select(F.col("sid").alias("a"), F.col("_first").alias("b"))
    near = links(by_fp.select("fp"))
    side = lambda name, fp: by_fp.select(F.col("_first").alias(name), F.col("fp").alias(fp))
    close = near.select(F.col("a").alias("_x"), F.col("b").alias("_y")).join(side("a", "_x"), "_x").join(side("b", "_y"), "_y").select("a", "b")
    return same.unionByName(close)


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without near duplicates: of each component the row of least id stays.

    Linked are all texts whose distinct five-word shingles have a Jaccard similarity of 0.8 or more. Pairs whose SimHash fingerprints share Golay keys are
    compared first; fingerprints of such pairs may differ by ten bits and more, so the rest is found by an exact join on shingles (shingle_join.py).

    Null and empty texts are alike; texts of fewer words than a shingle are one shingle; of repeated rows one stays; a null id comes first.
    """
    names, docs = docs.columns, set_apart(docs, "doc_id", "text")
    keyed = docs.withColumn("_row", row_key(docs))
    with passing(docs.sparkSession):
        other = materialize(_other(keyed, width), "other", lasting=True)
    once = keyed.join(shingle_join.bounded(other.select("_row")), "_row", "left_anti")
    many = other.where("_head")
    if not many.isEmpty():
        once = once.unionByName(keyed.join(shingle_join.bounded(many.select("_row")), "_row", "left_semi").dropDuplicates(["_row"]))
    return once.drop("_row").toDF(*names)


def _other(keyed: DataFrame, width: int) -> DataFrame:
    """keyed: doc_id, text and _row. _row, _head: the rows that go, and (_head) those that stay but are repeated; mostly few beside what simply stays."""
    own = shingle_join.with_set(keyed.select("text", F.struct("doc_id", "_row").alias("_order")), width, *shingle_join.frequent(keyed, width))
    by_set = materialize(own.groupBy("sid").agg(F.min("_order").alias("_least"), *[F.first(c).alias(c) for c in ("n", "prefix", "fp", "sketch", "bitmap")]), "sets")

    def texts(sids: DataFrame) -> DataFrame:
        first = materialize(by_set.join(sids, "sid").select("sid", F.col("_least")["_row"].alias("_row")), "asked")
        return keyed.select("_row", "text").join(shingle_join.bounded(first), "_row").select("text", "sid")

    roots = components(shingle_join.links(by_set.drop("_least"), texts, width, closest=close_pairs))
    named = by_set.select("sid", "_least").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    heads = named.groupBy("root").agg(F.min("_least").alias("_least")).select(F.col("_least")["_row"].alias("_row"))
    rows = keyed.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(heads.withColumn("_head", F.lit(True)), "_row", "left").where("_head is null or _n > 1")
    return rows.select("_row", F.col("_head").isNotNull().alias("_head"))
