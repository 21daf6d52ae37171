"""Cutting of notes into overlapping chunks with line ranges, and their enrichment."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

CHUNK_CHARS, OVERLAP, MOST_CHUNKS = 4000, 500, 2000


def cut(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(chunk_index, start_line, end_line, text) of each chunk that is not blank.

    A window of `size` characters ends early after its last blank line, if that lies past 60 % of it and past the overlap; the
    next one starts `overlap` characters before the end of this. Lines are those of the window before its ends are stripped.
    """
    if not text or size <= 0:
        return []
    overlap = max(0, overlap)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    line = lambda offset: bisect_right(breaks, offset - 1) + 1
    out, start = [], 0
    while True:
        end = min(len(text), start + size)
        blank = text.rfind("\n\n", start, end) - start
        if blank > int(0.6 * (end - start)) and blank + 2 > overlap:
            end = start + blank + 2
        if body := text[start:end].strip():
            out.append((len(out), line(start), line(max(start, end - 1)), body))
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


CHUNK = "rel_path string, chunk_index int, start_line int, end_line int, text string"


def chunk_rows(notes: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP, most: int = MOST_CHUNKS, cutter=cut) -> DataFrame:
    """notes: rel_path, text. The columns of CHUNK and error: one row for each chunk, at most `most` a note, and one for each note that fails, with the reason.

    The start of a chunk depends on the end of the one before, which no built-in function expresses; texts pass through
    Python once, in Arrow batches, without a shuffle. A note whose cutting raises an error costs no other note.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows, error = cutter(text or "", size, overlap)[:most], None
                except Exception as e:
                    rows, error = [(None, None, None, None)], f"{type(e).__name__}: {e}"
                if rows:
                    k, a, b, body = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(k)), pa.array(k, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(body, pa.string()), pa.array([error] * len(k), pa.string())],
                        ["rel_path", "chunk_index", "start_line", "end_line", "text", "error"],
                    )

    return notes.select("rel_path", "text").mapInArrow(run, f"{CHUNK}, error string")


def chunk_notes(notes: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP, most: int = MOST_CHUNKS) -> DataFrame:
    """The chunks of chunk_rows(); notes that fail have none."""
    return chunk_rows(notes, size, overlap, most).where("error is null").drop("error")


def enrich(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """chunks with chunk_id, basename, stem, mtime, heading (of the note, before the chunk) and first_line (of the chunk)."""
    x = chunks.join(notes.select("rel_path", "mtime", T.lines(F.col("text")).alias("_lines")), "rel_path")
    return x.select(
        T.chunk_id(F.col("rel_path"), F.col("mtime"), F.col("chunk_index")).alias("chunk_id"), "rel_path", T.basename(F.col("rel_path")).alias("basename"), T.stem(F.col("rel_path")).alias("stem"),
        "chunk_index", "start_line", "end_line", "mtime", T.heading_before(F.col("_lines"), F.col("start_line")).alias("heading"), T.first_nonempty_line(F.col("text")).alias("first_line"), "text",
    )
