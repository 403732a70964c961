"""A log of numbered entries, each of which exactly one writer creates: the number is taken atomically, losers try again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Log:
    """Entries 0, 1, 2 ... of a folder, as files of one JSON object.

    An entry is written whole beside its place and then put there by an operation that fails if the place is taken: a
    hard link on a local file system, a rename elsewhere, which doesn't replace (HDFS). No reader sees half an entry.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def entries(self) -> list[dict]:
        """All entries in order; the log is metadata, a line a change of state."""
        if not self._fs.exists(self._path("")):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return [json.loads(self._read(n)) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, number: int, text: str) -> bool:
        """Creates the entry; False if another writer has it."""
        target, draft = self._path(f"{number:012}.json"), self._path(f".draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() != "file":
                return not self._fs.exists(target) and self._fs.rename(draft, target)
            files, get = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.nio.file.Path.of
            try:
                files.createLink(get(target.toUri().getPath(), self._names()), get(draft.toUri().getPath(), self._names()))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                    return False
                raise
            return True
        finally:
            self._fs.delete(draft, False)

    def _names(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    def append(self, make: Callable[[list[dict]], dict], tries: int = 1000) -> int:
        """Adds what ``make`` returns for the entries there are, and returns its number.

        If another writer takes the number first, ``make`` is asked again with that entry among them; it may raise
        where its entry can't follow any more.
        """
        for _ in range(tries):
            known = self.entries()
            if self._put(len(known), json.dumps(make(known), sort_keys=True)):
                return len(known)
        raise RuntimeError(f"no number was free in {tries} tries")
