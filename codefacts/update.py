"""One codebase of an index brought up to date: list, detect, read what is new, extract, apply, write the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts import changes, corpus, extract, store
from codefacts.functions import extension
from codefacts.tables import settled


def register(spark: SparkSession, folder: str, codebases: DataFrame) -> int:
    """Adds codebases (name, root_path, type) to an index, or renames known ones; the new version's number."""
    based_on = store.current_version(spark, folder)
    known = store.read_index(spark, folder, ["codebases"], based_on)["codebases"].drop("codebase_id")
    return store.write_index({"codebases": settled(corpus.register_codebases(known, codebases.withColumn("created_at", F.current_timestamp())), "codebases")}, folder, based_on)


def update_index(spark: SparkSession, folder: str, codebase_id: int, root: str, headers_only: bool = False, prune: bool = False) -> DataFrame:
    """Brings a registered codebase of the index up to date with the files under root; counts of files by status.

    Only new and drifted files are opened. With headers_only, files with other extensions stay as they are, unless prune is set. The index is
    that of a full run over the files as they are now; a failure, or another run's write to this codebase, leaves it as it was.
    """
    based_on = store.current_version(spark, folder)
    tables = store.read_index(spark, folder, version=based_on, codebase_ids=[codebase_id])
    listing = corpus.discover_files(spark, root, headers_only).withColumn("codebase_id", F.lit(codebase_id).cast("long"))
    scope = extension(F.col("relative_path")).isin(*corpus.HEADERS) if headers_only and not prune else None
    found = settled(changes.detect_changes(tables["files"], listing, scope=scope), "changes")
    wanted = listing.join(found.filter(F.col("status").isin("new", "changed")), ["codebase_id", "relative_path"], "left_semi")
    sources = settled(corpus.from_table(corpus.read_sources(wanted), "codebase_id", "relative_path", "content"), "sources")
    out = changes.apply_changes(tables, found, extract.index_corpus(sources, linked=False))
    out["codebases"] = corpus.mark_indexed(tables["codebases"].drop("codebase_id"), spark.createDataFrame([(codebase_id,)], "id long"))
    store.write_index(out, folder, based_on)
    return changes.index_summary(found)
