"""State tables that change: copy-on-write partitions under a versioned manifest.

A table is a folder with `data` and `manifest`. Rows lie in a fixed number of partitions by a hash of their key; a version is
a manifest that names the folder of each partition. A merge reads the partitions that its updates touch, computes their new
rows, writes the partitions in which a row changed, and adds the next manifest. Manifests are added by a rename that fails
if the name is taken, so of two writers one goes first, and the other computes its change again on what the first left: no
decision is lost. A merge has a name; one that a version has already applied is done and changes nothing, so a job that is
run again after a failure repeats nothing. Readers see whole versions, old ones too until `vacuum` drops them.

Sizes: a manifest has a line for each partition and the names of the last `KEEP_NAMES` merges; the driver handles nothing
else. Keys are unique. A table without rows, updates without rows, and keys that hold nulls are fine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import cut

PARTITIONS = 64
KEEP_NAMES = 10_000
TRIES = 20


@dataclass
class Manifest:
    version: int
    keys: list[str]
    partitions: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)
    merges: list[str] = field(default_factory=list)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/manifest/{version:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions there, oldest first."""
    p, fs = _fs(spark, f"{path.rstrip('/')}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:20]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """Of that version, or of the latest."""
    if version is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no table at {path}")
        version = found[-1]
    p, fs = _fs(spark, _name(path, version))
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    m = Manifest(**json.loads(text))
    m.folders = {int(k): v for k, v in m.folders.items()}
    return m


def _commit(spark: SparkSession, path: str, m: Manifest) -> bool:
    """Adds the manifest under its version; False if that version is taken."""
    jvm, final = spark._jvm, _name(path, m.version)
    temp = f"{path.rstrip('/')}/manifest/.{m.version:020d}-{uuid.uuid4().hex}"
    p, fs = _fs(spark, temp)
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps(m.__dict__).encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    target = jvm.org.apache.hadoop.fs.Path(final)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(p, target, options)
        return True
    except Exception:
        fs.delete(p, False)
        if fs.exists(target):
            return False
        raise


def _place(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]), F.lit(n)).cast("int")


def _write(df: DataFrame, path: str) -> dict[int, str]:
    """df, with its partition in __p, to a new folder; the folders by partition."""
    name = f"data/{uuid.uuid4().hex}"
    where = f"{path.rstrip('/')}/{name}"
    df.hint("rebalance", "__p").write.partitionBy("__p").parquet(where)
    p, fs = _fs(df.sparkSession, where)
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return {int(n.removeprefix("__p=")): f"{name}/{n}" for n in found if n.startswith("__p=")}


def create(df: DataFrame, path: str, keys: list[str], partitions: int = PARTITIONS) -> Manifest:
    """A new table of df's rows: version 0. Fails if there is one."""
    spark = df.sparkSession
    m = Manifest(0, keys, partitions, df.schema.json(), _write(df.withColumn("__p", _place(keys, partitions)), path))
    if not _commit(spark, path, m):
        raise FileExistsError(f"there is a table at {path}")
    return m


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """Rows of a version, the latest if None; only: of these partitions."""
    m = manifest(spark, path, version)
    return _rows(spark, path, m, only)


def _rows(spark: SparkSession, path: str, m: Manifest, only: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(m.schema))
    folders = [f"{path.rstrip('/')}/{f}" for p, f in sorted(m.folders.items()) if only is None or p in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(spark: SparkSession, path: str, updates: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> Manifest:
    """The latest version after `change`, which gets the rows of the partitions that updates touch, and updates.

    updates has the key's columns; change returns all rows that these partitions shall hold, of any keys in updates or
    there before. name: of this merge; a name that was merged before changes nothing.
    """
    updates = cut(updates, "merge-updates")
    for _ in range(TRIES):
        m = manifest(spark, path)
        if name in m.merges:
            return m
        placed = updates.withColumn("__p", _place(m.keys, m.partitions))
        touched = [r[0] for r in placed.select("__p").distinct().collect()]  # as many as partitions, at most
        old = _rows(spark, path, m, touched)
        new = cut(change(old, updates).select(*old.columns).withColumn("__p", _place(m.keys, m.partitions)), "merge-rows")
        changed = _changed(old.withColumn("__p", _place(m.keys, m.partitions)), new)
        stray = [p for p in changed if p not in touched]
        if stray:
            raise ValueError(f"merge {name} made rows of partitions that it did not read: {stray[:5]}")
        folders = {p: f for p, f in m.folders.items() if p not in changed}
        if changed:
            folders |= _write(new.filter(F.col("__p").isin(changed)), path)
        after = Manifest(m.version + 1, m.keys, m.partitions, m.schema, folders, [*m.merges, name][-KEEP_NAMES:])
        if _commit(spark, path, after):
            return after
    raise PySparkException(f"merge {name}: {TRIES} other writers went first")


def _changed(old: DataFrame, new: DataFrame) -> list[int]:
    """Partitions whose rows, repeated ones counted, are not the same."""
    both = old.withColumn("__n", F.lit(-1)).unionByName(new.withColumn("__n", F.lit(1)))
    rows = both.groupBy(*old.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    return [r[0] for r in rows.select("__p").distinct().collect()]


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drops all but the last `keep` versions and the data that only they had; the number of folders dropped.

    For times without writers: what an unfinished merge has written looks like data of no version.
    """
    found = versions(spark, path)
    kept = [manifest(spark, path, v) for v in found[-keep:]]
    used = {f for m in kept for f in m.folders.values()}
    for v in found[:-keep]:
        p, fs = _fs(spark, _name(path, v))
        fs.delete(p, False)
    p, fs = _fs(spark, f"{path.rstrip('/')}/data")
    dropped = 0
    for batch in fs.listStatus(p):
        parts = [s.getPath() for s in fs.listStatus(batch.getPath())]
        names = [f"data/{batch.getPath().getName()}/{x.getName()}" for x in parts]
        dead = [x for x, n in zip(parts, names, strict=True) if n not in used]
        whole = not any(n in used for n in names)
        for x in [batch.getPath()] if whole else [x for x in dead if x.getName().startswith("__p=")]:
            fs.delete(x, True)
            dropped += 1
    return dropped
