"""Fact tables: their schemas, deterministic ids, name tables, tables written to the shared folder and how joins are planned."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: table -> columns, as Spark DDL
SCHEMAS = {
    "codebases": "id long, name string, root_path string, type string, created_at timestamp, last_indexed_at timestamp",
    "files": "file_id long, codebase_id long, relative_path string, absolute_path string, content_hash string, mtime double, file_size long, indexed_at timestamp",
    "symbols": "id long, file_id long, ord int, name string, qualified_name string, kind string, access string, is_static boolean, is_virtual boolean, is_const boolean, is_inline boolean, return_type string, line_start int, line_end int, column_start int, parent_symbol_id long, signature string, raw_text string",
    "parameters": "symbol_id long, name string, type string, default_value string, position int",
    "inheritance": "child_symbol_id long, parent_name string, parent_symbol_id long, access string, is_virtual boolean, child_name string",
    "ue_macros": "id long, file_id long, symbol_id long, macro_type string, line_number int, raw_text string",
    "ue_macro_specifiers": "macro_id long, ord int, key string, value string, is_meta boolean",
    "calls": "id long, file_id long, caller_symbol_id long, caller_name string, callee_symbol_id long, callee_name string, line_number int",
    "includes": "file_id long, line_number int, included_path string, is_system boolean, resolved_file_id long",
    "references_table": "symbol_id long, file_id long, symbol_name string, line_number int, column_number int, context string",
}
FUNCTION_KINDS = ("function", "method", "constructor", "destructor")
CLASS_KINDS = ("class", "struct", "interface")
_LIMIT, _MEASURED_LIMIT, _OWN_LIMIT = (f"spark.{x}.autoBroadcastJoinThreshold" for x in ("sql", "sql.adaptive", "codefacts"))


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def file_id(codebase_id: Column, relative_path: Column) -> Column:
    return F.xxhash64(codebase_id, relative_path)


def symbol_id(file: Column, ord_: Column) -> Column:
    """Ids follow from the file and the symbol's pre-order position, so they are the same in every run."""
    return F.xxhash64(file, ord_)


def located(files: DataFrame) -> DataFrame:
    """files with their id as file_id, whether it is called so or id."""
    return files if "file_id" in files.columns else files.withColumnRenamed("id", "file_id")


def with_codebase(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The fact tables, each with the codebase_id of its rows: of the file, or of the file of the symbol or macro that a row hangs on."""
    of_file = located(tables["files"]).select("file_id", "codebase_id") if "files" in tables else None
    out = dict(tables)
    for name, table in tables.items():
        if "codebase_id" in table.columns:
            continue
        if name == "codebases":
            out[name] = table.withColumn("codebase_id", F.col("id"))
        elif "file_id" in table.columns:
            out[name] = table.join(of_file, "file_id")
        else:
            key, parent = ("macro_id", "ue_macros") if "macro_id" in table.columns else ("symbol_id", "symbols") if "symbol_id" in table.columns else ("child_symbol_id", "symbols")
            out[name] = table.join(tables[parent].select(F.col("id").alias(key), "file_id").join(of_file, "file_id").drop("file_id"), key)
    return out


def names_table(spark: SparkSession, names: str | Iterable[str] | DataFrame, column: str = "q") -> DataFrame:
    """One name, a list of names or a one-column DataFrame as distinct rows of one column; a list, which the driver holds anyway, is broadcast."""
    if isinstance(names, DataFrame):
        return names.select(F.col(names.columns[0]).alias(column)).distinct()
    listed = [names] if isinstance(names, str) else list(names)
    return F.broadcast(spark.createDataFrame([(n,) for n in dict.fromkeys(listed)], f"{column} string"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of each key in a total order."""
    if limit is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def join_by_measured_sizes(spark: SparkSession, on: bool = True) -> None:
    """From now on the session broadcasts a table if its rows, as measured while the query runs, are within the session's limit; on=False sets its own plan again.

    Before a query runs Spark takes the bytes of a file for those of its rows. Keys and names lie in files at a tenth and less, so at
    a million rows a table that is estimated within the limit takes more memory than the driver has. Only broadcasts that the code asks for stay as they are.
    """
    limit = spark.conf.get(_LIMIT)
    if on and limit != "-1":
        if spark.conf.get(_MEASURED_LIMIT, None) is None or spark.conf.get(_OWN_LIMIT, None) is not None:
            spark.conf.set(_MEASURED_LIMIT, limit)
        spark.conf.set(_OWN_LIMIT, limit)
        spark.conf.set(_LIMIT, "-1")
    elif not on and limit == "-1" and spark.conf.get(_OWN_LIMIT, None) is not None:
        spark.conf.set(_LIMIT, spark.conf.get(_OWN_LIMIT))


def few(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """A table that ``settled`` wrote, to be broadcast if it is short: else the longer side of a join moves, too, before both are measured."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new temporary one if all runs in this one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written to the shared folder and read back: iterations keep a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``settled`` wrote, once nothing reads them any more; what is left behind would fill the shared folder."""
    for table in tables:
        spark = table.sparkSession
        top = shared_folder(spark).partition(":")[2] or shared_folder(spark)
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if (folder.partition(":")[2] or folder).lstrip("/").startswith(top.lstrip("/") + "/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
