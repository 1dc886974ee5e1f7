"""Small files of a store, through Hadoop's file systems: wherever Spark can write, so can these."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_EXISTS = ("java.nio.file.FileAlreadyExistsException", "org.apache.hadoop.fs.FileAlreadyExistsException")


@dataclass(frozen=True)
class Entry:
    name: str
    modified: datetime


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._conf)

    def entries(self, folder: str) -> list[Entry]:
        """What a folder holds, with times; nothing where it is missing."""
        place, system = self._at(folder)
        if not system.exists(place):
            return []
        return [
            Entry(status.getPath().getName(), datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc))
            for status in system.listStatus(place)
        ]

    def read(self, path: str) -> str:
        place, system = self._at(path)
        stream = system.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        place, system = self._at(path)
        return system.delete(place, True)

    def create_new(self, path: str, text: str) -> bool:
        """Create a file with its content at once; False, and nothing changed, where one of that name exists.

        The content is written under another name first.  Giving it its name is one step that fails if the name is
        taken: a rename on HDFS and file systems like it, a link on a local disk.  Object stores without such a step
        do not keep two writers apart.
        """
        folder, name = path.rsplit("/", 1)
        draft, system = self._at(f"{folder}/_{name}.{uuid.uuid4().hex}")
        stream = system.create(draft)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        place = system.makeQualified(self._jvm.org.apache.hadoop.fs.Path(path))
        try:
            if system.getUri().getScheme() == "file":
                local = lambda at: self._jvm.java.io.File(at.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(place), local(draft))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self._conf)
                no_options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(system.makeQualified(draft), place, no_options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getName() in _EXISTS:
                return False
            raise
        finally:
            system.delete(draft, False)
        return True
