"""The index on disk in versions: immutable data folders, and a manifest for each version that one rename makes current.

    folder/manifests/000000000007.json        of version 7: table -> codebase_id -> its data folder, and the columns of each run's tables
    folder/data/<run>/<table>/base=<codebase>  Parquet files of one run, never changed

A run writes its own data folders first and the manifest of the next version last, by renaming a finished file to a name that
must not exist yet. So a reader holds one whole version for as long as it likes, a run that fails leaves the version before
as it was, and an index can be read, changed and written back in place. Of two runs that end at once the second takes the
newer manifest and puts its own codebases into it; if both wrote one codebase it fails with ``Conflict``. A version costs the
codebases that its run wrote; ``vacuum`` deletes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.tables import SCHEMAS, struct_type, with_codebase

#: tables: table -> codebase -> data folder; columns: run and table -> schema as JSON
Manifest = dict[str, dict]


class Conflict(RuntimeError):
    """Another run has written one of the same codebases meanwhile."""


class Folder:
    """A folder of any file system that Spark reads, through its own Hadoop client."""

    def __init__(self, spark: SparkSession, at: str):
        self.jvm, self.gateway, self.at = spark._jvm, spark.sparkContext._gateway, at.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)

    def names(self, name: str) -> list[str]:
        path = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def age_ms(self, name: str) -> int:
        return int(time.time() * 1000) - self.fs.getFileStatus(self.path(name)).getModificationTime()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file under a name of its own and renames it; False if the name is taken by now."""
        temporary = f"temporary/{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path(name).getParent())
        stream = self.fs.create(self.path(temporary), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.path(temporary), self.path(name), none)
            return True
        except Exception as error:
            self.delete(temporary)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(n[:-5]) for n in Folder(spark, folder).names("manifests") if n.endswith(".json")]


def current_version(spark: SparkSession, folder: str) -> int:
    """The newest version; 0 where nothing was written yet."""
    return max(versions(spark, folder), default=0)


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    n = current_version(spark, folder) if version is None else version
    return json.loads(Folder(spark, folder).read(f"manifests/{n:012d}.json")) if n else {"tables": {}, "columns": {}}


def write_index(tables: dict[str, DataFrame], folder: str, based_on: int | None = None) -> int:
    """Writes fact tables as the next version and returns its number: these tables' rows of the codebases are replaced, others stay.

    The codebases are those of the files given (or of codebases, or of the first table); a table of theirs that has become empty
    loses its rows as well. Tables without codebase_id need the tables by which their rows hang on a file. based_on: the version
    that was read for this; if one of the codebases has been written since, ``Conflict`` is raised and nothing changes.
    """
    own = next((n for n in ("files", "codebases") if n in tables), next(iter(tables)))
    spark = tables[own].sparkSession
    store, run = Folder(spark, folder), uuid.uuid4().hex
    made: dict[str, dict[str, str]] = {}
    columns: dict[str, str] = {}
    for name, table in with_codebase(tables).items():
        at = f"data/{run}/{name}"
        table.withColumn("base", F.col("codebase_id")).write.partitionBy("base").parquet(f"{store.at}/{at}")
        columns[f"{run}/{name}"] = table.schema.json()
        made[name] = {n.partition("=")[2]: f"{at}/{n}" for n in store.names(at) if n.startswith("base=")}
    bases = set(made[own]).union(*made.values())
    seen = manifest(spark, folder, based_on) if based_on is not None else None
    while True:
        version = current_version(spark, folder)
        latest = manifest(spark, folder, version)
        if seen is not None:
            moved = sorted(b for b in bases for name in made if seen["tables"].get(name, {}).get(b) != latest["tables"].get(name, {}).get(b))
            if moved:
                store.delete(f"data/{run}")
                raise Conflict(f"codebases {sorted(set(moved))} were written after version {based_on}")
        for name, parts in made.items():
            latest["tables"][name] = {b: at for b, at in latest["tables"].get(name, {}).items() if b not in bases} | parts
        named = {"/".join(at.split("/")[1:3]) for parts in latest["tables"].values() for at in parts.values()}
        latest["columns"] = {at: c for at, c in (latest["columns"] | columns).items() if at in named}
        if store.write_new(f"manifests/{version + 1:012d}.json", json.dumps(latest, sort_keys=True)):
            return version + 1


def read_index(spark: SparkSession, folder: str, names: list[str] | None = None, version: int | None = None, codebase_ids: list[int] | None = None) -> dict[str, DataFrame]:
    """The tables of one version, each with codebase_id: of the newest, or of the one named; of all codebases or of some, whose folders alone are read."""
    found = manifest(spark, folder, version)
    wanted = None if codebase_ids is None else {str(c) for c in codebase_ids}
    out = {}
    for name in names or list(SCHEMAS):
        folders = [at for base, at in sorted(found["tables"].get(name, {}).items()) if wanted is None or base in wanted]
        if folders:
            # runs may have written other columns: what one lacks is null
            fields: dict[str, T.StructField] = {}
            for run in dict.fromkeys("/".join(at.split("/")[1:3]) for at in folders):
                fields |= {f.name: f for f in T.StructType.fromJson(json.loads(found["columns"][run])).fields}
            table = spark.read.schema(T.StructType(list(fields.values()))).parquet(*[f"{folder.rstrip('/')}/{at}" for at in folders])
        else:
            table = spark.createDataFrame([], struct_type(name))
        if "codebase_id" not in table.columns:
            table = table.withColumn("codebase_id", F.lit(None).cast("long"))
        out[name] = table.withColumn("codebase_id", F.col("codebase_id").cast("long"))
    return out


def vacuum(spark: SparkSession, folder: str, keep: int = 2, older_than_ms: int = 86_400_000) -> int:
    """Deletes all but the last versions, and data folders that none of those names; younger ones may belong to a run that has not ended. Returns how many folders went."""
    store, known = Folder(spark, folder), versions(spark, folder)
    for n in known[:-keep]:
        store.delete(f"manifests/{n:012d}.json")
    used = {at.split("/")[1] for n in known[-keep:] for parts in manifest(spark, folder, n)["tables"].values() for at in parts.values()}
    gone = [run for run in store.names("data") if run not in used and store.age_ms(f"data/{run}") >= older_than_ms]
    for run in gone:
        store.delete(f"data/{run}")
    return len(gone)
