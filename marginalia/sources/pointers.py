"""Numbered pointer files: version n of a table is a small JSON file that names its folders. Pointers are created, never overwritten or renamed.

A writer writes its data, then creates the pointer of the next number; where two writers race, the file system lets one create it, and the other gets
a Conflict. A reader takes the pointer of the highest number that is whole, so a writer that dies at any step leaves the last version in place.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published this version."""


def file_of(spark: SparkSession, path: str):
    """(file system, path) through Hadoop, so that any store that Spark reaches will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = file_of(spark, f"{path}/pointers")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def read(spark: SparkSession, path: str, number: int) -> dict | None:
    """What a pointer says, or None if it is not whole."""
    rows = spark.read.text(f"{path}/pointers/{number:012d}.json", wholetext=True).collect()
    try:
        said = json.loads(rows[0][0]) if rows else None
    except ValueError:
        return None
    return said if isinstance(said, dict) and said.pop("whole", False) else None


def newest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    for n in _numbers(spark, path):
        if (said := read(spark, path, n)) is not None:
            return n, said
    return None


def publish(spark: SparkSession, path: str, number: int, said: dict) -> None:
    fs, p = file_of(spark, f"{path}/pointers/{number:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"{path} has a version {number} already") from e
        raise
    out.write(bytearray(json.dumps(said | {"whole": True}).encode()))
    out.close()


def publish_next(spark: SparkSession, path: str, seen: int, said: dict) -> int:
    """Publish the version after the one that the writer has seen; the number. Numbers of pointers that a writer left unfinished are passed over."""
    number = seen + 1
    while number in (begun := _numbers(spark, path)) and read(spark, path, number) is None:
        number += 1
    if any(n >= number for n in begun):
        raise Conflict(f"{path} has changed since version {seen}")
    publish(spark, path, number, said)
    return number


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[dict]:
    """Delete all pointers but the newest `keep` whole ones; what those say."""
    left, fs = [], file_of(spark, path)[0]
    for n in _numbers(spark, path):
        said = read(spark, path, n)
        if said is not None and len(left) < keep:
            left.append(said)
        elif left:
            fs.delete(file_of(spark, f"{path}/pointers/{n:012d}.json")[1], False)
    return left
