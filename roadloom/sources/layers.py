"""Layers in versioned folders behind one pointer: readers see a whole layer, the old or the new one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the layer that is in force; None before the first."""
    pointer, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/{name}"


def point_to(spark: SparkSession, path: str, name: str) -> None:
    """Swap the pointer in one rename; until then the old one holds."""
    fresh, fs = _fs(spark, f"{path}/_{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(to), overwrite)


def write_layer(layer: DataFrame, path: str, form: str = "parquet") -> str:
    """Write a layer as a new version and make it the one in force; its folder.

    A layer may be made from the one in force: the old folder stays until drop_old(). A failure before the swap
    leaves the old layer readable and an unfinished folder that nothing points to. form: parquet or json (one feature a line).
    """
    spark = layer.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    layer.write.format(form).save(f"{path}/{name}")
    point_to(spark, path, f"{name}:{form}")
    return f"{path}/{name}"


def read_layer(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The layer in force."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"no layer at {path}")
    folder, _, form = at.rpartition(":")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(form).load(folder)


def drop_old(spark: SparkSession, path: str) -> int:
    """Delete all versions but the one in force, unfinished ones too; how many went. For when nothing reads or writes them."""
    at = current(spark, path)
    folder, fs = _fs(spark, path)
    keep = {POINTER, at.rpartition(":")[0].rsplit("/", 1)[-1] if at else POINTER}
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in keep and not s.getPath().getName().startswith(".")]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
