"""Incremental index: what changed since the last manifest, and the next generation of manifest and chunks.

Chunks lie in buckets of notes; a pass rewrites the buckets that have a changed note and refers to the others where they are. All is
written before a pointer file names it: a failed pass leaves the old tables in place. There is one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.chunks import CHUNK_CHARS, MOST_CHUNKS, OVERLAP, chunk_rows, cut, enrich
from marginalia.sources import manifest as M
from marginalia.sources.scratch import kept

SCHEMA_VERSION = "2"


def diff(files: DataFrame, manifest: DataFrame, force: bool = False, max_size_mb: float = 8.0) -> DataFrame:
    """files, manifest: rel_path, mtime, size. rel_path, status (new, changed, unchanged, deleted or oversize), mtime, size.

    One full outer join of two narrow tables by path; no text is read. An oversize file is reported as such and leaves the index.
    """
    old = manifest.select("rel_path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_old"))
    x = files.select("rel_path", "mtime", "size", F.lit(True).alias("_new")).join(old, "rel_path", "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    status = (
        F.when(F.col("_new").isNull(), "deleted").when(F.col("size") > max_size_mb * 1048576, "oversize").when(F.col("_old").isNull(), "new")
        .when(same & F.lit(not force), "unchanged").otherwise("changed")
    )
    return x.select("rel_path", status.alias("status"), F.coalesce("mtime", "_m").alias("mtime"), F.coalesce("size", "_s").alias("size"))


def stats(changes: DataFrame) -> DataFrame:
    """One row: scanned, updated, deleted, errors."""
    n = lambda *kinds: F.count(F.when(F.col("status").isin(*kinds), 1))
    return changes.agg(n("new", "changed", "unchanged", "oversize").alias("scanned"), n("new", "changed").alias("updated"), n("deleted").alias("deleted"), n("oversize").alias("errors"))


def next_manifest(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("status").isin("new", "changed", "unchanged")).select("rel_path", "mtime", "size")


def next_chunks(chunks: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks of unchanged notes stay, those of all others go, fresh ones come."""
    gone = changes.where(F.col("status") != "unchanged").select("rel_path")
    return chunks.join(gone, "rel_path", "left_anti").unionByName(fresh)


@dataclass
class IndexConfig:
    chunk_chars: int = CHUNK_CHARS
    chunk_overlap: int = OVERLAP
    max_chunks_per_file: int = MOST_CHUNKS
    max_file_size_mb: float = 8.0
    buckets: int = 64  # of a new index
    embed: object = None  # DataFrame with text -> the same with embedding
    cutter: object = cut  # text, size, overlap -> chunks
    extra: dict = field(default_factory=dict)


def _embedded(chunks: DataFrame, embed) -> DataFrame:
    """chunks with embedding. An embedding may have a column `error` of its own; a chunk that has one fails its note."""
    out = embed(chunks)
    return out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))


def index_once(spark: SparkSession, notes: DataFrame, path: str, config: IndexConfig | None = None, force: bool = False, progress=None) -> dict:
    """notes: rel_path, mtime, size, text. One pass into the index at path; the counters of the pass.

    A note that cannot be cut or embedded is an error of its own: it keeps the chunks and the manifest row that it had (none, if it is new), so the next
    pass tries it again, and all other notes are indexed. A stored generation of another schema version is indexed anew; the new generation
    carries the present version. progress is called with the phase (scan, chunk, commit, done) and its counts.
    """
    config, tell = config or IndexConfig(), progress or (lambda **x: None)
    old = M.current(spark, path)
    force = force or (old is not None and old.version != SCHEMA_VERSION)
    count = old.count if old else config.buckets
    changes = kept(diff(notes, old.files if old else M.empty_files(spark), force, config.max_file_size_mb), "changes")
    counters = stats(changes).first().asDict()
    tell(phase="scan", **counters)
    todo = notes.join(changes.where(F.col("status").isin("new", "changed")).select("rel_path"), "rel_path", "left_semi")
    rows, seen = chunk_rows(todo, config.chunk_chars, config.chunk_overlap, config.max_chunks_per_file, config.cutter), Observation("chunked")
    rows = kept(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("error").alias("failed")), "chunks")
    tell(phase="chunk", chunks=seen.get["rows"] - seen.get["failed"], failed=seen.get["failed"])
    fresh = enrich(rows.where("error is null").drop("error"), todo)
    failed = rows.where("error is not null").select("rel_path", "error")
    if config.embed is not None:
        fresh = kept(_embedded(fresh, config.embed), "embedded")
        failed = failed.union(fresh.where("error is not null").select("rel_path", "error"))
        fresh = fresh.drop("error")
    failed = kept(failed.groupBy("rel_path").agg(F.min("error").alias("error")), "failed")
    errors = failed.count()
    if errors:
        fresh = fresh.join(failed, "rel_path", "left_anti")
        changes = kept(_with_failures(changes, failed, old.files if old else M.empty_files(spark)), "changes")
        counters = counters | {"updated": counters["updated"] - errors, "errors": counters["errors"] + errors}
    moved = changes.where(F.col("status").isin("new", "changed", "deleted", "oversize"))
    # At most one number for each bucket.
    touched = sorted(r[0] for r in moved.select(M.bucket_of(count)).distinct().collect())
    if touched or old is None:
        tell(phase="commit", buckets=len(touched), **counters)
        before = M.read_buckets(spark, path, sorted(old.buckets[k] for k in touched if k in old.buckets)) if old else None
        M.commit(spark, path, next_manifest(changes), fresh if before is None else next_chunks(before, fresh, changes), touched, SCHEMA_VERSION, count)
    tell(phase="done", **counters)
    return counters


def _with_failures(changes: DataFrame, failed: DataFrame, manifest: DataFrame) -> DataFrame:
    """changes, in which a failed note stands as unchanged with the times and size that the manifest has of it, or as failed if it has none."""
    old = manifest.select("rel_path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    x = changes.join(failed.select("rel_path", F.lit(True).alias("_bad")), "rel_path", "left").join(old, "rel_path", "left")
    bad, had = F.col("_bad").isNotNull(), F.col("_s").isNotNull()
    status = F.when(bad & had, "unchanged").when(bad, "failed").otherwise(F.col("status"))
    return x.select("rel_path", status.alias("status"), F.when(bad & had, F.col("_m")).otherwise(F.col("mtime")).alias("mtime"), F.when(bad & had, F.col("_s")).otherwise(F.col("size")).alias("size"))
