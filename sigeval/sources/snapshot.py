"""Snapshot commit of results (A13, A14): a reader sees the old run or the new one.

A table is a folder of partition folders; each run writes its files into new
leaves ``snapshot=<id>`` below the partitions it holds. What counts is listed in one
manifest file, replaced by an atomic rename after all files are there. A partition
that a run does not hold keeps its leaves. A failed or killed write changes nothing
that a reader looks at; its files are removed by :func:`expire`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"
_SNAPSHOT = "snapshot"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """``{"snapshot": id, "leaves": {partition: leaf}}``; empty before the first commit."""
    jvm, p, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return {"snapshot": None, "leaves": {}, "schema": None}
    with_stream = fs.open(p)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
    finally:
        with_stream.close()
    return json.loads(text)


def _replace_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Writes beside and renames over: readers find one whole file at any time."""
    jvm, target, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    qualified = lambda x: context.makeQualified(x)
    context.rename(qualified(staged), qualified(target), options)


def _leaves(spark: SparkSession, path: str, snapshot: str, depth: int) -> dict[str, str]:
    """Partition -> leaf of one snapshot, from the folder names."""
    _, pattern, fs = _hadoop(spark, "/".join([path, *["*"] * depth, f"{_SNAPSHOT}={snapshot}"]))
    found = {}
    for status in fs.globStatus(pattern) or []:
        parts = str(status.getPath().toString()).split("/")
        found["/".join(parts[len(parts) - 1 - depth:-1])] = "/".join(parts[len(parts) - 1 - depth:])
    return found


def write_snapshot(df: DataFrame, path: str, by: tuple[str, ...] = (), replace_all: bool = False) -> str:
    """Writes ``df`` as a new snapshot and commits it: the partitions (``by``) that
    it holds take the place of the old ones, with ``replace_all`` of all. Returns
    the snapshot's id. Writers of one table must follow each other; a commit
    on a manifest that has changed meanwhile is refused."""
    spark = df.sparkSession
    before, snapshot = manifest(spark, path), uuid.uuid4().hex
    (df.withColumn(_SNAPSHOT, F.lit(snapshot)).write.mode("append").partitionBy(*by, _SNAPSHOT).parquet(path))
    leaves = _leaves(spark, path, snapshot, len(by))
    if not by and not leaves:                 # an empty table is a table
        leaves = {}
    if manifest(spark, path)["snapshot"] != before["snapshot"]:
        raise RuntimeError(f"{path} was committed by another writer")
    kept = {} if replace_all or not by else before["leaves"]
    _replace_manifest(spark, path, {"snapshot": snapshot, "leaves": {**kept, **leaves}, "schema": df.schema.json()})
    return snapshot


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows; FileNotFoundError before the first commit."""
    from pyspark.sql import types as T

    now = manifest(spark, path)
    if now["schema"] is None:
        raise FileNotFoundError(f"nothing committed at {path}")
    schema = T.StructType.fromJson(json.loads(now["schema"]))
    if not now["leaves"]:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField(_SNAPSHOT, T.StringType())])
    rows = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{leaf}" for leaf in sorted(now["leaves"].values())])
    return rows.select(*schema.names)


def expire(spark: SparkSession, path: str) -> int:
    """Deletes the leaves that the manifest does not list; call it when no
    reader works on an older manifest. Returns how many went."""
    now, gone = set(manifest(spark, path)["leaves"].values()), 0
    depth = max((leaf.count("/") for leaf in now), default=0)
    _, pattern, fs = _hadoop(spark, "/".join([path, *["*"] * depth, f"{_SNAPSHOT}=*"]))
    for status in fs.globStatus(pattern) or []:
        leaf = "/".join(str(status.getPath().toString()).split("/")[-1 - depth:])
        if leaf not in now:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
