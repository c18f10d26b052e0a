"""Folders and files that all executors share, through Hadoop's file systems only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/loomspan-checkpoints"  # local masters only, where the driver's disk is the executors' disk


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local master uses LOCAL_FOLDER and any other master is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = LOCAL_FOLDER
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read from there: cuts lineage and spares repeated scans."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """(file system, path object) of a path in any store that Hadoop knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = file_system(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError("a folder could not be published")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, sorted; nothing if there is no such folder."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Published by a rename: readers see the old text, none, or the new one, never a part."""
    fs, at = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    except BaseException:
        stream.close()
        fs.delete(draft, False)
        raise
    stream.close()
    if not fs.rename(draft, at):
        fs.delete(at, False)
        if not fs.rename(draft, at):
            raise OSError("a file could not be published")


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))
