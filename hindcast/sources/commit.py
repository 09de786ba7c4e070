"""Replacing partitions of a Parquet table.

A job may not read and overwrite the same files, so new partitions are written
to a staging folder beside the table first. Publishing then swaps directories
by rename, one per day: data is written once. The staging folder keeps the old
directories until the end, and a run that died half-way is rolled forward by
:func:`recover`.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from hindcast.sources.tables import laid_out

MARK = "_PUBLISH"
STALE_MS = 24 * 3600 * 1000


class _Files:
    """The few Hadoop file system calls used here, on one base path."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self.hadoop.Path(text)

    def exists(self, text: str) -> bool:
        return self.fs.exists(self.path(text))

    def names(self, text: str) -> list[str]:
        if not self.exists(text):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(text)))

    def age_ms(self, text: str) -> float:
        return time.time() * 1000 - self.fs.getFileStatus(self.path(text)).getModificationTime()

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, text: str) -> None:
        self.fs.delete(self.path(text), True)

    def write(self, text: str, lines: list[str]) -> None:
        out = self.fs.create(self.path(text), True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()

    def read(self, text: str) -> list[str]:
        size = self.fs.getFileStatus(self.path(text)).getLen()
        stream = self.fs.open(self.path(text))
        try:
            return [line for line in bytes(stream.readNBytes(int(size))).decode().split("\n") if line]
        finally:
            stream.close()


def _staging_root(table: str) -> str:
    return table.rstrip("/") + ".staging"


def stage(df: DataFrame, table: str, partition: str, order: list[str],
          options: dict[str, str] | None = None) -> str:
    """Write replacement partitions beside the table; the table is not touched."""
    staged = f"{_staging_root(table)}/{uuid.uuid4().hex}"
    writer = laid_out(df, partition, *order).write.partitionBy(partition)
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    writer.parquet(f"{staged}/new")
    return staged


def publish(spark: SparkSession, table: str, staged: str, emptied: list[str] = (),
            whole: bool = False) -> None:
    """Swap the staged partitions in. ``emptied`` names partitions
    (``column=value``) that have no rows left; with ``whole``, that is every
    live one the staging lacks."""
    files = _Files(spark, table)
    parts = [n for n in files.names(f"{staged}/new") if "=" in n]
    gone = [n for n in files.names(table) if "=" in n] if whole else list(emptied)
    parts += [n for n in gone if n not in parts]
    files.write(f"{staged}/{MARK}", parts)
    _swap(files, table, staged, parts)
    spark.catalog.refreshByPath(table)


def _swap(files: _Files, table: str, staged: str, parts: list[str]) -> None:
    for part in parts:
        live, new, old = f"{table}/{part}", f"{staged}/new/{part}", f"{staged}/old/{part}"
        if files.exists(live) and not files.exists(old):
            files.rename(live, old)
        if files.exists(new):
            files.rename(new, live)
    files.delete(staged)


def recover(spark: SparkSession, table: str) -> int:
    """Finish publishes that died half-way and drop staging that never began
    and is older than ``STALE_MS``: younger staging may be a running job's.
    Returns how many were finished."""
    files = _Files(spark, table)
    finished = 0
    for name in files.names(_staging_root(table)):
        staged = f"{_staging_root(table)}/{name}"
        if files.exists(f"{staged}/{MARK}"):
            _swap(files, table, staged, files.read(f"{staged}/{MARK}"))
            finished += 1
        elif files.age_ms(staged) > STALE_MS:
            files.delete(staged)
    if finished:
        spark.catalog.refreshByPath(table)
    return finished
