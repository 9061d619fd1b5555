"""Code facts in closed form from the part and lineitem tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.tables import symbol_id

VIEWS = {
    "fx_class": """SELECT p_partkey AS pk, concat('APart', p_partkey) AS class_name,
  CASE WHEN p_partkey = 0 THEN 'AActor' ELSE concat('APart', CAST(floor(p_partkey / 3) AS BIGINT)) END AS parent_name,
  1 + p_size % 3 AS codebase_id, concat('Mod', p_size) AS module, p_size, p_name, p_brand, p_type, p_retailprice FROM part""",
    "fx_files": """SELECT pk * 2 AS file_id, codebase_id, concat(module, '/Public/Part', pk, '.h') AS relative_path FROM fx_class
 UNION ALL SELECT pk * 2 + 1, codebase_id, concat(module, '/Private/Part', pk, '.cpp') FROM fx_class
 UNION ALL SELECT -1 - size, 1 + size % 3, concat('Mod', size, '/Public/Types.h') FROM (SELECT DISTINCT p_size AS size FROM part) t""",
    "fx_includes": """SELECT c.pk * 2 AS file_id, 3 AS line_number,
  CASE c.pk % 4 WHEN 0 THEN concat(q.module, '/Public/Part', q.pk, '.h') WHEN 1 THEN concat('Part', q.pk, '.h')
    WHEN 2 THEN 'Public/Types.h' ELSE 'vector' END AS included_path, CASE WHEN c.pk % 4 = 3 THEN 1 ELSE 0 END AS is_system
  FROM fx_class c JOIN fx_class q ON q.pk = CAST(floor(c.pk / 3) AS BIGINT)
 UNION ALL SELECT pk * 2 + 1, 1, concat('Part', pk, '.h'), 0 FROM fx_class""",
    "fx_inheritance": "SELECT class_name AS child_name, parent_name, 'public' AS access, pk FROM fx_class",
    "fx_edge": """SELECT DISTINCT l_partkey AS a, (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % (SELECT count(*) FROM part) AS b
  FROM lineitem""",
    "fx_calls": """SELECT a * 2 + 1 AS file_id, concat('APart', a, '::Run', a) AS caller_name, concat('Run', b) AS callee_name,
  CAST(4 + row_number() OVER (PARTITION BY a ORDER BY b) AS BIGINT) AS line_number FROM fx_edge""",
    "fx_symbols": """SELECT pk * 2 AS file_id, 0 AS ord, class_name AS name, class_name AS qualified_name, 'class' AS kind, 6 AS line_start FROM fx_class
 UNION ALL SELECT pk * 2, 1, concat('Run', pk), concat(class_name, '::Run', pk), 'method', 11 FROM fx_class
 UNION ALL SELECT pk * 2, 2, concat('Price', pk), concat(class_name, '::Price', pk), 'field', 13 FROM fx_class
 UNION ALL SELECT pk * 2 + 1, 0, concat('Run', pk), concat(class_name, '::Run', pk), 'method', 3 FROM fx_class""",
    "fx_macros": """SELECT pk * 2 AS file_id, 5 AS line_number, 'UCLASS' AS macro_type, 0 AS sym_ord FROM fx_class
 UNION ALL SELECT pk * 2, 8, 'GENERATED_BODY', 1 FROM fx_class
 UNION ALL SELECT pk * 2, 10, 'UFUNCTION', 1 FROM fx_class
 UNION ALL SELECT pk * 2, 12, 'UPROPERTY', 2 FROM fx_class""",
    "fx_specifiers": """SELECT pk * 2 AS file_id, 5 AS line_number, 0 AS ord, 'Blueprintable' AS key, CAST(NULL AS VARCHAR(99)) AS value, 0 AS is_meta FROM fx_class
 UNION ALL SELECT pk * 2, 5, 1, 'ClassGroup', p_type, 0 FROM fx_class
 UNION ALL SELECT pk * 2, 5, 2, 'DisplayName', p_name, 1 FROM fx_class
 UNION ALL SELECT pk * 2, 10, 0, 'BlueprintCallable', NULL, 0 FROM fx_class
 UNION ALL SELECT pk * 2, 10, 1, 'Category', p_brand, 0 FROM fx_class
 UNION ALL SELECT pk * 2, 12, 0, 'EditAnywhere', NULL, 0 FROM fx_class
 UNION ALL SELECT pk * 2, 12, 1, 'BlueprintReadWrite', NULL, 0 FROM fx_class
 UNION ALL SELECT pk * 2, 12, 2, 'ClampMin', CAST(p_size AS VARCHAR(99)), 1 FROM fx_class""",
    "fx_cpp": """SELECT pk * 2 + 1 AS file_id, concat('#include "Part', pk, '.h"', chr(10), chr(10)) AS head, concat('void ', class_name, '::Run', pk, '(int32 Size)', chr(10), '{{', chr(10), coalesce(c.body, ''), '}}') AS body, coalesce(c.n, 0) AS n_calls
  FROM fx_class LEFT JOIN (SELECT file_id, count(*) AS n, string_agg(concat('    ', callee_name, '();', chr(10)), '' ORDER BY line_number) AS body FROM fx_calls GROUP BY file_id) c ON c.file_id = pk * 2 + 1""",
    "fx_header": """SELECT pk * 2 AS file_id, concat('#pragma once', chr(10), '// ', p_name, chr(10), i.line, chr(10), chr(10),
  'UCLASS(Blueprintable, ClassGroup=(', p_type, '), meta=(DisplayName="', p_name, '"))', chr(10),
  'class MOD_API ', class_name, ' : public ', parent_name, chr(10), '{{', chr(10), '    GENERATED_BODY()', chr(10), 'public:', chr(10),
  '    UFUNCTION(BlueprintCallable, Category="', p_brand, '")', chr(10), '    virtual void Run', pk, '(int32 Size);', chr(10),
  '    UPROPERTY(EditAnywhere, BlueprintReadWrite, meta=(ClampMin="', p_size, '"))', chr(10), '    float Price', pk, ';', chr(10), '}};', chr(10)) AS text
  FROM fx_class JOIN (SELECT file_id, CASE WHEN is_system = 1 THEN concat('#include <', included_path, '>') ELSE concat('#include "', included_path, '"') END AS line
    FROM fx_includes WHERE line_number = 3) i ON i.file_id = pk * 2""",
}


def sql(query: str, recursive: bool = False) -> str:
    """A DuckDB query over the views that it (and they) name."""
    used: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in used:
                used.add(name)
                need(VIEWS[name])

    need(query)
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})".replace("{{", "{").replace("}}", "}") for name in VIEWS if name in used)
    body = query.strip()
    head = f"WITH {'RECURSIVE ' * recursive}{ctes}"
    if not used:
        return query
    return f"{head}, {body[5:].removeprefix('RECURSIVE ')}" if body.startswith("WITH ") else f"{head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of sf_dir."""
    used: list[str] = []

    def need(text: str) -> None:
        for other in VIEWS:
            if other in text and other not in used:
                need(VIEWS[other])
                used.append(other)

    need(VIEWS[name])
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    text = f"WITH {ctes} {VIEWS[name]}" if ctes else VIEWS[name]
    for table in ("part", "lineitem"):
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {table}", f"{word} {{{table}}}")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem") if f"{{{t}}}" in text}
    return spark.sql(text, **read)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_files")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_symbols with ids, what the rendered text says of them and, for members of a header's class, the class's id."""
    s = view(spark, sf_dir, "fx_symbols").withColumn("id", symbol_id(F.col("file_id"), F.col("ord")))
    member = (F.col("ord") > 0) & (F.col("file_id") % 2 == 0)
    method, pk = F.col("kind") == "method", F.floor(F.col("file_id") / 2).cast("string")
    return s.withColumns({
        "parent_symbol_id": F.when(member, symbol_id(F.col("file_id"), F.lit(0))), "access": F.when(member, "public"), "is_static": F.lit(False), "is_virtual": member & method,
        "return_type": F.when(method, "void").when(F.col("kind") == "field", "float"), "signature": F.when(method, F.concat(F.lit("void "), F.when(member, F.lit("")).otherwise(F.concat(F.lit("APart"), pk, F.lit("::"))), "name", F.lit("(int32 Size)"))),
    })


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "fx_calls")
    return c.withColumn("id", F.xxhash64("file_id", "line_number", "caller_name", "callee_name"))


def macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "fx_macros")
    return m.select(F.xxhash64("file_id", "line_number").alias("id"), "file_id", "line_number", "macro_type", symbol_id(F.col("file_id"), F.col("sym_ord")).alias("symbol_id"))


def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "fx_specifiers")
    return s.select(F.xxhash64("file_id", "line_number").alias("macro_id"), "ord", "key", "value", (F.col("is_meta") == 1).alias("is_meta"))


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "fx_inheritance")
    return i.select(symbol_id(F.col("pk") * 2, F.lit(0)).alias("child_symbol_id"), "child_name", "parent_name", "access", F.lit(False).alias("is_virtual"), F.lit(None).cast("long").alias("parent_symbol_id"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered headers and implementation files: file_id, codebase_id, relative_path, content."""
    header = view(spark, sf_dir, "fx_header")
    lines = calls(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_number", F.concat(F.lit("    "), "callee_name", F.lit("();\n")).alias("t")))).alias("c"))
    classes = view(spark, sf_dir, "fx_class").select((F.col("pk") * 2 + 1).alias("file_id"), "pk", "class_name")
    body = F.concat_ws("", F.transform("c", lambda x: x["t"]))
    cpp = classes.join(lines, "file_id", "left").select("file_id", F.concat(F.lit('#include "Part'), "pk", F.lit('.h"\n\nvoid '), "class_name", F.lit("::Run"), "pk", F.lit("(int32 Size)\n{\n"), F.coalesce(body, F.lit("")), F.lit("}\n")).alias("text"))
    return header.unionByName(cpp).join(files(spark, sf_dir), "file_id").select("file_id", "codebase_id", "relative_path", F.col("text").alias("content"))
