"""Notes from a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources.listing import FolderSource

EXTENSIONS = (".md", ".txt")


def _scan(spark: SparkSession, root: str, extensions, content: bool) -> DataFrame:
    """rel_path, abs_path, mtime, size, and content if asked for: one scan, whichever source lists the files."""
    root = root.removeprefix("file:") if "://" not in root else root
    if "://" not in root:
        spark.dataSource.register(FolderSource)
        raw = spark.read.format("note_files").option("content", str(content).lower()).option("extensions", ",".join(extensions)).load(root)
        return raw.where("error is null").select("rel_path", "abs_path", "mtime", "size", *["content"] * content)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    low = F.lower(T.basename(rel))
    fits = F.lit(False)
    for e in extensions:
        fits = fits | (low.endswith(e) & (F.length(low) > len(e)))
    return raw.select(rel.alias("rel_path"), F.col("path").alias("abs_path"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), F.col("length").alias("size"), *["content"] * content).where(fits)


def discover(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """rel_path, abs_path, mtime (seconds), size of the files below root whose suffix, lower-cased, is one of the extensions.

    Content is not read. A folder of the file system is listed by sources.listing, hidden names too; in a store (a path with a scheme) Spark's
    own listing is used, which leaves out names that begin with a dot or an underscore.
    """
    return _scan(spark, root, extensions, False)


def read_notes(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """discover() with text, in one scan: UTF-8 with malformed bytes replaced, line ends as \\n."""
    raw = _scan(spark, root, extensions, True)
    return raw.select("rel_path", "abs_path", "mtime", "size", T.decode(F.col("content")).alias("text"))
