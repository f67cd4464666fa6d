"""Appends to a table folder under an identity, so that a repeated batch adds nothing.

An append is known by its job and batch, which name its files; the table's layout stays
as it is, and files of different jobs lie side by side. Rows are written to a hidden
folder of the table, counted there, then moved into place. A small record in `_commits`
says which files belong to the append: one that is pending marks files of an attempt that
broke off, which are removed before the next one; one that is done makes a repetition a
no-op. Readers see neither folder. The filesystem has to rename files, as HDFS does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RECORDS = "_commits"


class AppendMismatch(RuntimeError):
    """Not all the rows that were sent have been written."""


class _Folder:
    """Hadoop's view of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._path(self.root, name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def move(self, old: str, new: str) -> None:
        target = self.at(new)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self.at(old), target):
            raise OSError(f"cannot move {old} to {new}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def files(self, name: str) -> list[str]:
        """Data files below a folder, relative to it."""
        top = self.fs.makeQualified(self.at(name))
        found, listing = [], self.fs.listFiles(top, True)
        while listing.hasNext():
            relative = top.toUri().relativize(listing.next().getPath().toUri()).getPath()
            if not any(part.startswith(("_", ".")) for part in relative.split("/")):
                found.append(relative)
        return sorted(found)


def job_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a job: kept beside its checkpoint, so that a fresh one is another job."""
    folder = _Folder(spark, checkpoint)
    if not folder.exists("_job"):
        folder.write("_job", uuid.uuid4().hex)
    return folder.read("_job").strip()


def identity(job: str, batch: int | None) -> str:
    """Name of an append; without a batch every append is its own."""
    if batch is None:
        return f"append-{uuid.uuid4().hex}"
    if not job:
        raise ValueError("a batch number needs the job that it belongs to")
    return f"{job}-{batch:012d}"


def append(
    spark: SparkSession,
    path: str,
    name: str,
    write: Callable[[str], int | None],
    count: Callable[[str], int] | None = None,
) -> bool:
    """Add what `write` puts into the folder it is given; False if `name` is there already.

    `write` returns how many rows it sent, `count` how many a folder holds; they have to
    agree before anything becomes visible.
    """
    table = _Folder(spark, path)
    done, pending = f"{RECORDS}/{name}.done", f"{RECORDS}/{name}.pending"
    if table.exists(done):
        return False
    if table.exists(pending):
        for old in table.read(pending).splitlines():
            table.remove(old)
    staged = f"_staged-{name}-{uuid.uuid4().hex[:8]}"
    try:
        sent = write(f"{path}/{staged}")
        if count is not None and sent:
            found = count(f"{path}/{staged}")
            if found != sent:
                raise AppendMismatch(f"{name}: {found} of {sent} rows written")
        moves = []
        for k, file in enumerate(table.files(staged)):
            folder, _, last = file.rpartition("/")
            moves.append((f"{staged}/{file}", f"{folder}/{name}-{k:05d}.{last.partition('.')[2]}".lstrip("/")))
        table.write(pending, "\n".join(new for _, new in moves))
        for old, new in moves:
            table.move(old, new)
        table.move(pending, done)
    finally:
        table.remove(staged)
    return True


def compact(spark: SparkSession, path: str, folder: str, write: Callable[[str, str], None]) -> tuple[int, int]:
    """Rewrite the files of one folder of the table; returns their number before and after.

    `write(source, target)` writes the folder's rows anew. Run it while nothing appends to
    this folder. Records of past appends stay, so repeated batches are still known.
    """
    table = _Folder(spark, path)
    old = table.files(folder)
    name = f"compact-{uuid.uuid4().hex}"
    staged = f"_staged-{name}"
    try:
        write(f"{path}/{folder}", f"{path}/{staged}")
        fresh = table.files(staged)
        targets = [f"{folder}/{name}-{k:05d}.{file.rpartition('/')[2].partition('.')[2]}" for k, file in enumerate(fresh)]
        for file, target in zip(fresh, targets, strict=True):
            table.move(f"{staged}/{file}", target)
        for file in old:
            table.remove(f"{folder}/{file}")
    finally:
        table.remove(staged)
    return len(old), len(fresh)


def drop_folders(spark: SparkSession, path: str, expired: Callable[[str], bool]) -> list[str]:
    """Remove the table's first-level folders that `expired` names; returns them."""
    table = _Folder(spark, path)
    names = [s.getPath().getName() for s in table.fs.listStatus(table.root) if s.isDirectory()]
    gone = sorted(n for n in names if not n.startswith(("_", ".")) and expired(n))
    for name in gone:
        table.remove(name)
    return gone
