"""Content that readers see whole or not at all.

A writer puts its files under a new name that nobody reads, and then creates or replaces one small file that
names them. That file is moved into place, so a reader finds the old one or the new one, and a writer that
died on the way leaves files that no reader follows. It is the way Spark keeps the offsets of a stream.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"
VERSIONS = "versions"


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    return fs, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _move_in(spark: SparkSession, path: str, text: str, option: str) -> None:
    fs, target, files = _hadoop(spark, path)
    draft = fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = getattr(fs.Options.Rename, option)
    try:
        fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration()).rename(
            files.makeQualified(draft), files.makeQualified(target), options)
    finally:
        files.delete(draft, False)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False if there is one already, of which the content stays."""
    if _hadoop(spark, path)[2].exists(_hadoop(spark, path)[1]):
        return False
    try:
        _move_in(spark, path, text, "NONE")
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a file in place of the one that is there, or of none."""
    _move_in(spark, path, text, "OVERWRITE")


def read_file(spark: SparkSession, path: str) -> str | None:
    _, target, files = _hadoop(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    _, target, files = _hadoop(spark, path)
    return files.exists(target)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    _, target, files = _hadoop(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def manifest(spark: SparkSession, folder: str) -> dict:
    """What was published last; empty if nothing was."""
    text = read_file(spark, f"{folder}/{MANIFEST}")
    return json.loads(text) if text else {}


@contextmanager
def new_version(spark: SparkSession, folder: str, **notes: object) -> Iterator[str]:
    """A fresh path to write to; it is published with the notes when the block ends without an error.

    The version before stays for those who read it now; older ones are removed.
    """
    before = manifest(spark, folder)
    name = uuid.uuid4().hex
    yield f"{folder}/{VERSIONS}/{name}"
    replace_file(spark, f"{folder}/{MANIFEST}", json.dumps({"version": name, "before": before.get("version"), **notes}))
    if before.get("before"):
        _, old, files = _hadoop(spark, f"{folder}/{VERSIONS}/{before['before']}")
        files.delete(old, True)


def current(spark: SparkSession, folder: str) -> str:
    """The path of the published version; a folder without versions is read as it is."""
    version = manifest(spark, folder).get("version")
    return f"{folder}/{VERSIONS}/{version}" if version else folder
