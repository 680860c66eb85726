"""Folders that readers see whole or not at all.

Output is written beside its place and renamed once it is whole, by the file system that
Spark uses for the path. Where renaming a folder is not one step (object stores copy),
``publish_version`` is still safe: what readers follow is one small file, renamed last.
"""

import uuid

from pyspark.sql import SparkSession

# The file that names the current version of a versioned folder.
POINTER = "CURRENT"
VERSION = "version-"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs


def exists(spark: SparkSession, path: str) -> bool:
    files, at, _ = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that a job of ours has written; one that isn't there is no error."""
    files, at, _ = _file_system(spark, path)
    files.delete(at, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    files, at, fs = _file_system(spark, source)
    to = fs.Path(target)
    if files.exists(to) or not files.rename(at, to):
        raise FileExistsError(f"cannot rename {source} to {target}")


def beside(path: str, purpose: str) -> str:
    """A new path in the folder of ``path``, hidden from readers of that folder."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent or '.'}/_{name}-{purpose}-{uuid.uuid4().hex}"


def publish_folder(spark: SparkSession, staged: str, target: str, mode: str) -> None:
    """Make a whole folder of part files the target, or add its files to it under ``append``.

    An older target under ``overwrite`` steps aside first and is removed last, so that a failure
    in between leaves one of them whole, at ``target`` or beside it.
    """
    files, at, fs = _file_system(spark, staged)
    to = fs.Path(target)
    if not files.exists(to):
        files.mkdirs(to.getParent())
        return rename(spark, staged, target)
    if mode == "overwrite":
        old = beside(target, "old")
        rename(spark, target, old)
        rename(spark, staged, target)
        return delete(spark, old)
    # Part names hold the id of the job that wrote them.
    for status in files.listStatus(at):
        part = status.getPath()
        if not part.getName().startswith("_"):
            rename(spark, part.toString(), f"{target.rstrip('/')}/{part.getName()}")
    files.delete(at, True)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A new file of one short text."""
    files, at, _ = _file_system(spark, path)
    stream = files.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a short file, or None if there is none."""
    files, at, _ = _file_system(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readNBytes(1 << 16)).decode()
    finally:
        stream.close()


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename one file over another, in one step where the file system has such a step."""
    _, at, fs = _file_system(spark, source)
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(at, fs.Path(target), over)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version of ``path`` that its pointer names, or None where nothing was published."""
    return read_small(spark, f"{path.rstrip('/')}/{POINTER}")


def publish_version(spark: SparkSession, path: str, version: str, keep: int) -> None:
    """Make the whole folder ``path/version`` what readers of ``path`` follow.

    Of older versions the ``keep`` latest stay, for readers that have just followed the pointer.
    """
    root = path.rstrip("/")
    pointer = f"{root}/{POINTER}"
    # Hidden, and of its own name: two that publish at once don't meet.
    draft = f"{root}/_{POINTER}-{uuid.uuid4().hex}"
    write_small(spark, draft, version)
    replace_file(spark, draft, pointer)
    files, at, _ = _file_system(spark, root)
    old = [(s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(at) if s.isDirectory()]
    old = sorted((t, name) for t, name in old if name.startswith(VERSION) and name != version)
    for _, name in old[: max(0, len(old) - keep)]:
        delete(spark, f"{root}/{name}")


def new_version() -> str:
    return f"{VERSION}{uuid.uuid4().hex}"
