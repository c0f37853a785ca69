"""Tables whose partitions are replaced in one step, with columns that may be added.

A table is a folder with data folders and manifests. A writer first writes its rows to a new data folder and then a new
manifest, which names the folders of every scope (a value of each column in `by`). Readers take the last complete
manifest, so they see a scope's old rows or its new ones and nothing between, and a writer that fails before its manifest
leaves the table as it was. Manifests are numbered and never overwritten; of two writers at once one fails and may try again.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; under a local master that has none, as in tests, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return context.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """(file system, its path object) of a path in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """The last complete manifest: its number, the columns of scopes, and the folders of each."""
    for name in sorted((n for n in children(spark, path) if n.startswith("manifest-")), reverse=True):
        fs, where = file_system(spark, f"{path}/{name}")
        stream = fs.open(where)
        try:
            found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # its writer was lost on the way
            continue
        finally:
            stream.close()
        return found
    return {"number": 0, "by": [], "folders": {}}


def scope_name(by: list[str], scope: dict) -> str:
    return json.dumps([None if scope[c] is None else str(scope[c]) for c in by])


def stage(df: DataFrame, path: str, by: list[str]) -> dict[str, str]:
    """Write df to a new folder by scopes: the folder of each scope. Nothing that readers see has changed yet."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    # the columns themselves stay in the files, as folders of several writers are read together
    named = F.to_json(F.array(F.lit(None).cast("string"), *[F.col(c).cast("string") for c in by]), {"ignoreNullFields": "false"})
    df.withColumn("_scope", named).write.partitionBy("_scope").parquet(f"{path}/{folder}")
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [n for n in children(spark, f"{path}/{folder}") if n.startswith("_scope=")]
    return {json.dumps(json.loads(unescape(n.removeprefix("_scope=")))[1:]): f"{folder}/{n}" for n in names}


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, old ones first; a column keeps its type."""
    have = {f.name: f for f in old}
    if odd := [f.name for f in new if f.name in have and have[f.name].dataType != f.dataType]:
        raise ValueError(f"columns {odd} have another type in the table")
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*old, *(f for f in new if f.name not in have)]])


def switch(df: DataFrame, path: str, by: list[str], staged: dict[str, str], gone: list[str] | None = None) -> int:
    """Make staged folders of df the rows of their scopes, and empty scopes that are gone, in one step: the manifest's number."""
    spark = df.sparkSession
    last = manifest(spark, path)
    if last["number"] and last["by"] != by:
        raise ValueError(f"{path} has scopes by {last['by']}")
    folders = {k: v for k, v in last["folders"].items() if k not in (gone or [])} | staged
    schema = merged(T.StructType.fromJson(last["schema"]) if last["number"] else T.StructType(), df.schema)
    number = 1 + max([0, *(int(n[9:-5]) for n in children(spark, path) if n.startswith("manifest-"))])
    fs, where = file_system(spark, f"{path}/manifest-{number:012d}.json")
    out = fs.create(where, False)  # fails if another writer was first
    out.write(bytearray(json.dumps({"number": number, "by": by, "schema": schema.jsonValue(), "folders": folders}).encode()))
    out.close()
    return number


def publish(df: DataFrame, path: str, by: list[str], scope: dict | None = None) -> int:
    """Replace the scopes that df has rows of, and `scope` in any case, which without rows is emptied.

    df may lack columns of the table or bring new ones: what a row's writer didn't have reads as null.
    """
    return switch(df, path, by, stage(df, path, by), [scope_name(by, scope)] if scope else [])


def current(spark: SparkSession, path: str, scope: dict | None = None) -> DataFrame:
    """The rows of a table, or of those scopes that have these values in the columns named; only their folders are read."""
    last = manifest(spark, path)
    if not last["number"]:
        raise ValueError(f"there is no table at {path}")
    wanted = {last["by"].index(c): None if v is None else str(v) for c, v in (scope or {}).items()}
    folders = [f"{path}/{f}" for k, f in last["folders"].items() if all(json.loads(k)[i] == v for i, v in wanted.items())]
    schema = T.StructType.fromJson(last["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def forget(spark: SparkSession, path: str) -> None:
    """Delete data folders and manifests that the last manifest doesn't need; readers of older ones must be done."""
    last = manifest(spark, path)
    kept = {f.split("/")[1] for f in last["folders"].values()}
    old = [f"data/{n}" for n in children(spark, f"{path}/data") if n not in kept]
    old += [n for n in children(spark, path) if n.startswith("manifest-") and n != f"manifest-{last['number']:012d}.json"]
    for name in old:
        fs, where = file_system(spark, f"{path}/{name}")
        fs.delete(where, True)
