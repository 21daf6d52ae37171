"""Periodic indexing with kept state: a stream of new files tells which notes have come or changed; what has gone is found by a sweep.

The keyed state is a row for each path (time and size when it was last indexed, and the sweep that last saw it), kept by Spark's state store. A batch
reads only the files that the stream names; the index rewrites only the buckets of notes whose state has changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.index import IndexConfig, index_once
from marginalia.sources.files import EXTENSIONS, read_notes

SEEN = "rel_path string, mtime double, size bigint, sweep bigint"
CHANGE = "rel_path string, status string, mtime double, size bigint"


def changes(seen: DataFrame) -> DataFrame:
    """seen: a stream of rel_path, mtime, size, sweep; a null size marks a path that a sweep has missed. A stream of CHANGE: new, changed and deleted notes.

    A path that is seen again as it was is no change, so files that arrive twice cost nothing; of several rows of a path in a batch the newest counts.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        rows = pd.concat(list(batches))
        last = rows.sort_values(["sweep", "mtime"], na_position="last").iloc[-1]
        if pd.isna(last["size"]):
            out = [] if old is None else [(key[0], "deleted", old[0], old[1])]
            if old is not None:
                state.remove()
        else:
            now = (float(last["mtime"]), int(last["size"]))
            out = [] if old == now else [(key[0], "new" if old is None else "changed", *now)]
            state.update(now)
        yield pd.DataFrame(out, columns=["rel_path", "status", "mtime", "size"])

    return seen.groupBy("rel_path").applyInPandasWithState(step, CHANGE, "mtime double, size bigint", "append", GroupStateTimeout.NoTimeout)


def keep_changes(seen: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of changes to a folder of Parquet files, one folder for each batch; a batch that is run again overwrites its own."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes(seen).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, index_dir: str, checkpoint: str, config: IndexConfig | None = None, every_minutes: int | None = None, extensions=EXTENSIONS) -> StreamingQuery:
    """A stream of the folder's new files whose batches each trigger a whole pass (which also sees changed and deleted files).

    every_minutes None: what is there now, then stop; else every so many minutes. The files' content is not read by the stream.
    """
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")

    def run(batch, number: int) -> None:
        index_once(batch.sparkSession, read_notes(batch.sparkSession, root, extensions), index_dir, config)

    out = seen.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = out.trigger(availableNow=True) if every_minutes is None else out.trigger(processingTime=f"{max(1, every_minutes)} minutes")
    return trigger.start()
