"""Small files and listings through Hadoop's file systems, so that every path means the same on all machines of a cluster."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    path: str
    size: int
    modified: int


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])


def plain(path: str) -> str:
    """A local path without its scheme; others as they are."""
    return path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path


class Storage:
    """Files below paths of any scheme that the session's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole file in one step: others see the old text or the new one."""
        fs, p = self._at(path)
        new = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        out = fs.create(new, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self._conf).rename(fs.makeQualified(new), fs.makeQualified(p), how)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def files(self, path: str, recursive: bool = True) -> list[Entry]:
        """Every file below a folder, or the file itself, in the order of paths; hidden ones are left out. Nothing there gives none."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = []
        each = fs.listFiles(p, recursive)
        while each.hasNext():
            f = each.next()
            name = f.getPath().getName()
            if not name.startswith((".", "_")):
                found.append(Entry(plain(f.getPath().toString()), f.getLen(), f.getModificationTime()))
        return sorted(found)
