"""Training-order materialisation: token ids cut into fixed-length sequences, put into a keyed random order, in fixed-stride shards.

Stream. The token ids of all documents, each ended by an end-of-document id, form one stream that is cut every STRIDE ids. Documents are
encoded where they are read and dealt out into blocks of about BLOCK_BYTES by a hash of id and content, packed; blocks follow each other in the stream
by number, and documents within a block by id. A block is written as one row. The blocks' sums are put in order and added up (global_order) and joined
back, so every block knows where it starts, all blocks are cut at once, and every sequence number 0..n-1 is known where it is cut. The last sequence is
filled up with a padding id.

Order. The keyed Feistel permutation of feistel.py, cycle-walking on 0..n-1, gives sequence s the global slot p(s); anyone can compute it and its
inverse from n and the key.

Shards. Slot x lies in shard x div PER_SHARD at place x mod PER_SHARD. Range partition r holds shards r * PER_RANGE to (r + 1) * PER_RANGE - 1: since slots
are numbers without gaps, the ranges are known and equal, and rows go straight to partition r, are sorted there by slot, and are put together one
shard at a time. Partition r is one file, part-r (file_of). A shard is one row of it: its slots' ids end to end at a fixed stride, little-endian, so
place k starts at byte k * STRIDE * bytes. Spark's writer commits whole files, so a lost executor leaves no half shard, and any store that Spark
writes will do. read_slots() reads any range of slots in order, from the files of the range only, so a run resumes at any slot.

Memory is bounded by a block (or one larger document) and by a shard. The ids are dealt out twice, by block and by range, and the files of the first exchange
go before the second begins.

Edge cases: a null text counts as empty and is a sole end-of-document id; equal rows follow each other; null ids come first; an empty table
gives no shard. Columns other than doc_id, text and the one that ids names are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import feistel
from marginalia.llm.common import global_order, materialize, passing, with_let
from marginalia.sources.scratch import tidy

STRIDE, PER_SHARD, PER_RANGE, KEY = 2048, 2048, 2, 77
SHARD = "shard long, first_slot long, slots int, payload binary"
BLOCK_BYTES = 16 << 20
#: Ids of the byte vocabulary that follow its 256 bytes.
END, PAD = 256, 257
ID_BYTES = 2
#: Documents whose ids are Python's objects at a time.
SLICE = 256


def _packed(ids: np.ndarray, level: int = 3) -> bytes:
    """Ids by planes of bytes, compressed: the high bytes are alike and cost next to nothing."""
    return zstandard.ZstdCompressor(level=level).compress(ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def materialise(docs: DataFrame, path: str, ids: Column | None = None, ids_bytes: int = 1, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY, end: int = END, pad: int = PAD, id_bytes: int = ID_BYTES, block_bytes: int = BLOCK_BYTES, per_range: int = PER_RANGE, encode: Callable[[list[str]], list] | None = None) -> int:
    """Write the shards of docs (doc_id, text) below path; the number of sequences.

    encode: gives the ids of each of some texts; it runs in the tasks that read them. Else ids: a binary column of little-endian unsigned ids of ids_bytes
    each (default: the text's UTF-8 bytes, a byte vocabulary). The shards hold ids of id_bytes. docs is read twice: give a table or a cheap plan.
    """
    spark, kind, own = docs.sparkSession, f"<u{id_bytes}", f"<u{ids_bytes}"
    text = F.coalesce(F.col("text"), F.lit(""))
    content = text if encode else text.cast("binary") if ids is None else F.coalesce(ids, F.lit(b""))
    total = docs.agg(F.sum((F.octet_length(content) / ids_bytes).cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-total * ids_bytes // block_bytes))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), content), F.lit(blocks)).cast("int").alias("block")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ids and the end's, packed."""
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                rows = batch.slice(first, SLICE)
                held = rows.column("content").to_pylist()
                each = encode(held) if encode else [np.frombuffer(x, dtype=own) for x in held]
                data = [_packed(np.append(np.asarray(x, dtype=kind), np.array([end], dtype=kind)), 1) for x in each]
                yield pa.RecordBatch.from_arrays([rows.column("block"), rows.column("doc_id"), pa.array(data, pa.binary())], ["block", "doc_id", "data"])

    def joined(table: pa.Table) -> pa.Table:
        """A block's stream: its documents by id, those of one id by their ids."""
        rows = [(d is not None, d if d is not None else 0, x[:-1].astype(f">u{id_bytes}").tobytes(), x) for d, x in zip(table["doc_id"].to_pylist(), (_unpacked(x.as_py(), kind) for x in table["data"]))]
        stream = np.concatenate([x for *_, x in sorted(rows, key=lambda r: r[:3])])
        return pa.table({"block": table["block"].slice(0, 1), "n": pa.array([len(stream)], pa.int64()), "data": pa.array([_packed(stream)], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                stream = _unpacked(data.as_py(), kind)
                edges = np.arange(-(-start // stride) * stride, start + len(stream), stride) - start
                edges = np.unique(np.concatenate([[0], edges, [len(stream)]]))
                pieces = [_packed(stream[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                at = edges[:-1] + start
                yield pa.RecordBatch.from_pydict({"slot": pa.array(feistel.permute(at // stride, n, key)), "at": pa.array((at % stride).astype(np.int32)), "data": pa.array(pieces, pa.binary())})

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order of slot and place; a shard is given out as soon as one of the next begins."""
        shard, out = -1, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": [shard], "first_slot": [shard * per_shard], "slots": pa.array([len(out)], pa.int32()), "payload": pa.array([out.tobytes()], pa.binary())})

        for batch in batches:
            for slot, at, data in zip(batch["slot"].to_pylist(), batch["at"].to_pylist(), batch["data"]):
                if slot // per_shard != shard:
                    if out is not None:
                        yield row()
                    shard = slot // per_shard
                    out = np.full((min(per_shard, n - shard * per_shard), stride), pad, dtype=kind)
                part = _unpacked(data.as_py(), kind)
                out[slot - shard * per_shard, at : at + len(part)] = part
        if out is not None:
            yield row()

    with passing(spark):
        id_kind = docs.schema["doc_id"].dataType.simpleString()
        dealt = docs.select(block, "doc_id", content.alias("content")).mapInArrow(coded, f"block int, doc_id {id_kind}, data binary")
        # One row a block, written once: with it the exchange by block is done with before the next begins, and blocks are cut where they are read.
        streams = materialize(dealt.groupBy("block").applyInArrow(joined, "block int, n long, data binary"), "streams", "none")
        n = -(-(streams.agg(F.sum("n")).first()[0] or 0) // stride)
        # Where each block starts: sums in order of the block, one row for each BLOCK_BYTES of input.
        starts = global_order(streams.select("block", "n"), ["block"], "n").select("block", F.col("start_at").alias("start"))
        pieces = streams.join(F.broadcast(starts), "block").select("start", "data").mapInArrow(cut, "slot long, at int, data binary")
        ranges = max(1, -(-n // (per_shard * per_range)))
        placed = pieces.repartitionById(ranges, F.floor(F.col("slot") / F.lit(per_shard * per_range)).cast("int"))
        with tidy(spark):
            placed.sortWithinPartitions("slot", "at").mapInArrow(assemble, SHARD).write.option("compression", "zstd").parquet(path)
    return n


def file_of(slot: int, per_shard: int = PER_SHARD, per_range: int = PER_RANGE) -> str:
    """How the name of the file that holds a slot begins."""
    return f"part-{slot // (per_shard * per_range):05d}-"


def read_slots(spark: SparkSession, path: str, first: int = 0, last: int | None = None, stride: int = STRIDE, per_shard: int = PER_SHARD, id_bytes: int = ID_BYTES, per_range: int = PER_RANGE, ordered: bool = True) -> DataFrame:
    """shard, slot, ids (binary) of the slots first..last (exclusive; None: all that follow), from the files of that range only; in the order of slots, unless ordered is False."""
    kept = spark.read.schema(SHARD).parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("long")
    # Files are ruled out by their names, and shards within a file by its statistics.
    rows = kept.where((number >= first // (per_shard * per_range)) & (F.col("shard") >= first // per_shard))
    if last is not None:
        rows = rows.where((number <= (last - 1) // (per_shard * per_range)) & (F.col("shard") <= (last - 1) // per_shard))
    width = stride * id_bytes
    # Slots are cut out before the rows multiply, so that no row but the shard's own carries the payload; bound once, it is not copied for each slot.
    cut = with_let(F.col("payload"), lambda p: F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda k: F.struct((F.col("first_slot") + k).alias("slot"), F.substring(p, k * width + 1, F.lit(width)).alias("ids"))))
    each = rows.select("shard", F.inline(cut)).where(F.col("slot") >= first)
    each = each if last is None else each.where(F.col("slot") < last)
    return each.orderBy("slot") if ordered else each


def sequence_at(slots: DataFrame, n: int, key: int = KEY) -> DataFrame:
    """slots with sequence: the number in the stream of the sequence that the permutation put there."""
    @F.pandas_udf("long")
    def back(slot: pd.Series) -> pd.Series:
        return pd.Series(feistel.permute(slot.to_numpy(), n, key, inverse=True))

    return slots.withColumn("sequence", back("slot"))
