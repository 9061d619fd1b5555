"""The registered queries over the given tables and the SQL that answers each of them in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts import changes, corpus, extract, functions, graph, link, macros, reports, search, store, testdata, trigrams
from codefacts.tables import file_id, join_by_measured_sizes, settled, shared_folder, symbol_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function under its own name, with its SQL over tables and fx views. Its tables may be of any size, so joins are planned by measured sizes."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            join_by_measured_sizes(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = testdata.sql(sql, recursive)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linked calls, symbols, files."""
    symbols, files = testdata.symbols(spark, d), testdata.files(spark, d)
    known = link.resolve_names_in_file(testdata.calls(spark, d), symbols)
    return link.resolve_calls(known, symbols, files), symbols, files


def _names(prefix: str, *numbers: int) -> list[str]:
    return [f"{prefix}{n}" for n in numbers]


# calls -----------------------------------------------------------------------------------------

_CALLEES = """callees AS (SELECT codebase_id, name, arg_min(qualified_name || '@' || relative_path || ':' || s.line_start, relative_path || '#' || ord) AS target
  FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id WHERE kind = 'method' GROUP BY 1, 2)"""


@query("""SELECT c.file_id, line_number, caller_name, callee_name, p.qualified_name AS caller_symbol, q.qualified_name AS callee_symbol
FROM fx_calls c LEFT JOIN fx_symbols p ON p.file_id = c.file_id AND p.qualified_name = c.caller_name
LEFT JOIN fx_symbols q ON q.file_id = c.file_id AND q.name = c.callee_name""")
def resolve_names_in_file(spark, d):
    symbols = testdata.symbols(spark, d)
    out = link.resolve_names_in_file(testdata.calls(spark, d), symbols)
    for side in ("caller", "callee"):
        out = out.join(symbols.select(F.col("id").alias(f"{side}_symbol_id"), F.col("qualified_name").alias(f"{side}_symbol")), f"{side}_symbol_id", "left")
    return out.select("file_id", "line_number", "caller_name", "callee_name", "caller_symbol", "callee_symbol")


@query(f"""WITH {_CALLEES}
SELECT c.file_id, line_number, caller_name, callee_name, coalesce(
  CASE WHEN q.qualified_name IS NULL THEN NULL ELSE q.qualified_name || '@' || f.relative_path || ':' || q.line_start END, k.target) AS target
FROM fx_calls c JOIN fx_files f ON f.file_id = c.file_id LEFT JOIN fx_symbols q ON q.file_id = c.file_id AND q.name = c.callee_name
LEFT JOIN callees k ON k.codebase_id = f.codebase_id AND k.name = c.callee_name""")
def resolve_calls(spark, d):
    calls, symbols, files = _calls(spark, d)
    at = symbols.join(files, "file_id").select(F.col("id").alias("callee_symbol_id"), F.concat("qualified_name", F.lit("@"), "relative_path", F.lit(":"), "line_start").alias("target"))
    return calls.join(at, "callee_symbol_id", "left").select("file_id", "line_number", "caller_name", "callee_name", "target")


@query("SELECT callee_name AS q, 'Run' || ((file_id - 1) // 2) AS caller, relative_path AS path, line_number FROM fx_calls JOIN fx_files USING (file_id)")
def find_callers(spark, d):
    calls, symbols, files = _calls(spark, d)
    return graph.find_callers(calls, symbols, files, symbols.select("name"), limit=None)


@query("""SELECT q, callee_name AS callee, relative_path AS path, line_number FROM (
  SELECT 'Run' || ((file_id - 1) // 2) AS q, * FROM fx_calls UNION ALL SELECT caller_name, * FROM fx_calls
) JOIN fx_files USING (file_id)""")
def find_callees(spark, d):
    calls, symbols, files = _calls(spark, d)
    return graph.find_callees(calls, symbols, files, symbols.select(F.explode(F.array("name", "qualified_name"))), limit=None)


@query("""SELECT DISTINCT f.codebase_id, callee_name AS name FROM fx_calls c JOIN fx_files f ON f.file_id = c.file_id
WHERE NOT EXISTS (SELECT 1 FROM fx_symbols s JOIN fx_files g ON g.file_id = s.file_id WHERE s.kind = 'method' AND s.name = c.callee_name AND g.codebase_id = f.codebase_id)""")
def unresolved_names(spark, d):
    calls, _, _ = _calls(spark, d)
    return link.unresolved_names(calls, "callee_name", "callee_symbol_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part")
    return part.filter("p_partkey % 50 = 7").select(F.lit("Run1").alias("start"), F.concat(F.lit("Run"), "p_partkey").alias("target"))


# every target has more than 20 last hops within five calls, so the SQL need not follow longer paths to know the nearest 20
@query("""WITH RECURSIVE paths AS (
  SELECT 1 AS node, 0 AS depth, [1] AS visited
  UNION ALL SELECT e.b, p.depth + 1, list_append(p.visited, e.b) FROM paths p JOIN fx_edge e ON e.a = p.node WHERE p.depth < 3 AND NOT list_contains(p.visited, e.b)
), hits AS (SELECT DISTINCT 'Run' || e.b AS target, p.depth + 1 AS depth, e.a FROM paths p JOIN fx_edge e ON e.a = p.node WHERE e.b % 50 = 7 AND NOT list_contains(p.visited, e.b)),
located AS (SELECT 'Run1' AS start, target, depth, 'Run' || a AS caller, relative_path AS path, line_number FROM hits
  JOIN fx_calls c ON c.file_id = a * 2 + 1 AND c.callee_name = target JOIN fx_files f ON f.file_id = c.file_id)
SELECT start, target, depth, caller, path, line_number FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, path, line_number, caller) AS n FROM located) WHERE n <= 20""", True)
def call_chain_hops(spark, d):
    edges = graph.call_edges(*_calls(spark, d))
    return graph.call_chain_hops(edges.filter(~F.col("src").contains("::")), _pairs(spark, d))


@query("""WITH RECURSIVE near AS (
  SELECT 1 AS node, 0 AS depth UNION SELECT e.b, n.depth + 1 FROM near n JOIN fx_edge e ON e.a = n.node WHERE n.depth < 10
), dist AS (SELECT node, min(depth) AS depth FROM near GROUP BY 1),
step AS (SELECT e.b AS node, arg_min(e.a, 'Run' || e.a) AS parent, d.depth FROM dist d JOIN fx_edge e ON e.b = d.node JOIN dist p ON p.node = e.a AND p.depth = d.depth - 1 GROUP BY e.b, d.depth),
back AS (
  SELECT node AS target, depth AS hop, parent, node FROM step WHERE node % 50 = 7
  UNION SELECT b.target, s.depth, s.parent, s.node FROM back b JOIN step s ON s.node = b.parent
)
SELECT 'Run1' AS start, 'Run' || target AS target, hop, 'Run' || parent AS caller, 'Run' || node AS callee FROM back""", True)
def shortest_call_paths(spark, d):
    edges = graph.call_edges(*_calls(spark, d))
    return graph.shortest_call_paths(edges.filter(~F.col("src").contains("::")), _pairs(spark, d))


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Twenty targets for every start."""
    part = _read(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))
    rows = part.join(F.broadcast(n)).select("p_partkey", "n", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    return rows.select(F.concat(F.lit("Run"), "p_partkey").alias("start"), F.concat(F.lit("Run"), (F.col("p_partkey") * 7 + F.col("k") * 13) % F.col("n")).alias("target"))


def _level(n: int) -> str:
    """Recursive step in SQL without recursion: nodes at n calls from s, each with the smallest name before it."""
    seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM l{i} m WHERE m.s = l.s AND m.node = e.b)" for i in range(n))
    return f"l{n} AS MATERIALIZED (SELECT l.s, e.b AS node, arg_min(e.a, 'Run' || e.a) AS parent FROM l{n - 1} l JOIN edge e ON e.a = l.node WHERE true {seen} GROUP BY 1, 2)"


def _hops(n: int) -> str:
    """SQL: the hops of pairs at n calls."""
    parts = [f"h{n}_{n} AS (SELECT w.s, w.t, {n} AS hop, l.parent, l.node FROM wanted w JOIN l{n} l ON l.s = w.s AND l.node = w.t)"]
    for i in range(n - 1, 0, -1):
        parts.append(f"h{n}_{i} AS (SELECT h.s, h.t, {i} AS hop, l.parent, l.node FROM h{n}_{i + 1} h JOIN l{i} l ON l.s = h.s AND l.node = h.parent)")
    return ", ".join(parts)


# no pair of the given tables is more than four calls apart
@query(f"""WITH edge AS MATERIALIZED (SELECT a, b FROM fx_edge), l0 AS (SELECT DISTINCT a AS s, a AS node, a AS parent FROM edge), {", ".join(_level(n) for n in range(1, 5))},
wanted AS (SELECT DISTINCT pk AS s, (pk * 7 + k * 13) % (SELECT count(*) FROM part) AS t FROM fx_class, range(1, 21) r(k)),
{", ".join(_hops(n) for n in range(1, 5))}
SELECT 'Run' || s AS start, 'Run' || t AS target, hop, 'Run' || parent AS caller, 'Run' || node AS callee
FROM ({" UNION ALL ".join(f"SELECT * FROM h{n}_{i}" for n in range(1, 5) for i in range(1, n + 1))})""")
def shortest_paths_from_all(spark, d):
    edges = graph.call_edges(*_calls(spark, d))
    return graph.shortest_call_paths(edges.filter(~F.col("src").contains("::")), _all_pairs(spark, d))


# classes -----------------------------------------------------------------------------------------


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    symbols, files = testdata.symbols(spark, d), testdata.files(spark, d)
    return link.resolve_inheritance(testdata.inheritance(spark, d), symbols, files), symbols, files


@query("""SELECT c.class_name AS child_name, c.parent_name, CASE WHEN p.codebase_id = c.codebase_id THEN p.module || '/Public/Part' || p.pk || '.h' END AS path
FROM fx_class c LEFT JOIN fx_class p ON p.class_name = c.parent_name""")
def resolve_inheritance(spark, d):
    inheritance, symbols, files = _classes(spark, d)
    at = symbols.join(files, "file_id").select(F.col("id").alias("parent_symbol_id"), F.col("relative_path").alias("path"))
    return inheritance.join(at, "parent_symbol_id", "left").select("child_name", "parent_name", "path")


@query("""SELECT c.class_name AS q, c.parent_name, 'public' AS access, CASE WHEN p.codebase_id = c.codebase_id THEN p.module || '/Public/Part' || p.pk || '.h' END AS path,
  CASE WHEN p.codebase_id = c.codebase_id THEN 6 END AS line_start FROM fx_class c LEFT JOIN fx_class p ON p.class_name = c.parent_name""")
def class_parents(spark, d):
    inheritance, symbols, files = _classes(spark, d)
    return graph.class_parents(inheritance, symbols, files, symbols.select("name"))


@query("SELECT parent_name AS q, class_name AS child, module || '/Public/Part' || pk || '.h' AS path, 6 AS line_start FROM fx_class")
def class_children(spark, d):
    inheritance, symbols, files = _classes(spark, d)
    return graph.class_children(inheritance, symbols, files, inheritance.select("parent_name"))


#: ancestors of every class with the class that names each as its parent; and where they are declared, if in that class's codebase
_UP = """up AS (SELECT class_name AS q, parent_name AS name, 1 AS depth, codebase_id AS base FROM fx_class WHERE parent_name <> class_name
  UNION SELECT u.q, c.parent_name, u.depth + 1, c.codebase_id FROM up u JOIN fx_class c ON c.class_name = u.name WHERE u.depth < 20 AND c.parent_name <> c.class_name),
  placed_up AS (SELECT q, name, depth, 'public' AS access, module || '/Public/Part' || pk || '.h' AS path, CASE WHEN pk IS NOT NULL THEN 6 END AS line_start FROM up LEFT JOIN fx_class p ON p.class_name = name AND p.codebase_id = base)"""

#: descendants of every class and parent
_DOWN = """down AS (SELECT parent_name AS q, class_name AS name, 1 AS depth FROM fx_class WHERE parent_name <> class_name
  UNION SELECT u.q, c.class_name, u.depth + 1 FROM down u JOIN fx_class c ON c.parent_name = u.name AND c.class_name <> c.parent_name WHERE u.depth < 20),
  placed_down AS (SELECT q, name, depth, 'public' AS access, module || '/Public/Part' || pk || '.h' AS path, 6 AS line_start FROM down JOIN fx_class ON class_name = name)"""


def _every_class(spark: SparkSession, d: str) -> DataFrame:
    """All names of classes, whether they are declared or only named as a parent."""
    both = testdata.inheritance(spark, d).select(F.explode(F.array("child_name", "parent_name")).alias("q"))
    return both.distinct()


@query(f"WITH RECURSIVE {_UP} SELECT * FROM placed_up", True)
def class_ancestors(spark, d):
    return graph.class_ancestors(*_classes(spark, d), _every_class(spark, d))


@query(f"WITH RECURSIVE {_DOWN} SELECT * FROM placed_down", True)
def class_descendants(spark, d):
    return graph.class_descendants(*_classes(spark, d), _every_class(spark, d), distinct=True)


@query(f"WITH RECURSIVE {_UP}, {_DOWN} SELECT *, 'ancestors' AS direction FROM placed_up UNION ALL SELECT *, 'descendants' FROM placed_down", True)
def class_hierarchy(spark, d):
    return graph.class_hierarchy(*_classes(spark, d), _every_class(spark, d))


# includes ----------------------------------------------------------------------------------------

_RESOLVED = """rows AS (SELECT i.*, f.codebase_id, list_last(string_split(included_path, '/')) AS base FROM fx_includes i JOIN fx_files f ON f.file_id = i.file_id),
named AS (SELECT *, list_last(string_split(relative_path, '/')) AS base FROM fx_files),
single AS (SELECT codebase_id, base, min(file_id) AS file_id FROM named GROUP BY 1, 2 HAVING count(*) = 1),
suffix AS (SELECT r.codebase_id, r.included_path, arg_min(n.file_id, n.relative_path) AS file_id FROM (SELECT DISTINCT codebase_id, included_path, base FROM rows) r
  JOIN named n ON n.codebase_id = r.codebase_id AND n.base = r.base AND ends_with(n.relative_path, r.included_path) GROUP BY 1, 2),
resolved AS (SELECT r.file_id, r.line_number, r.included_path, r.is_system, r.codebase_id, CASE WHEN r.is_system = 0 THEN coalesce(e.file_id, s.file_id, x.file_id) END AS target
  FROM rows r LEFT JOIN fx_files e ON e.codebase_id = r.codebase_id AND e.relative_path = r.included_path
  LEFT JOIN single s ON s.codebase_id = r.codebase_id AND s.base = r.base LEFT JOIN suffix x ON x.codebase_id = r.codebase_id AND x.included_path = r.included_path)"""


def _includes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = testdata.files(spark, d)
    return link.resolve_includes(testdata.view(spark, d, "fx_includes"), files), files


@query(f"WITH {_RESOLVED} SELECT r.file_id, line_number, included_path, is_system, t.relative_path AS target FROM resolved r LEFT JOIN fx_files t ON t.file_id = r.target")
def resolve_includes(spark, d):
    includes, files = _includes(spark, d)
    target = files.select(F.col("file_id").alias("resolved_file_id"), F.col("relative_path").alias("target"))
    return includes.join(target, "resolved_file_id", "left").select("file_id", "line_number", "included_path", "is_system", "target")


@query(f"""WITH {_RESOLVED}, wanted AS (SELECT file_id, relative_path AS q FROM fx_files)
SELECT q, 'includes' AS direction, t.relative_path AS path, included_path, line_number FROM resolved r JOIN wanted w ON w.file_id = r.file_id LEFT JOIN fx_files t ON t.file_id = r.target
UNION ALL SELECT q, 'included_by', f.relative_path, included_path, line_number FROM resolved r JOIN wanted w ON w.file_id = r.target JOIN fx_files f ON f.file_id = r.file_id""")
def file_dependencies(spark, d):
    includes, files = _includes(spark, d)
    return graph.file_dependencies(includes, files, files.select("relative_path"))


@query(f"""WITH RECURSIVE {_RESOLVED}, reach AS (
  SELECT file_id AS start, file_id AS node, 0 AS depth FROM fx_files
  UNION SELECT h.start, r.target, h.depth + 1 FROM reach h JOIN resolved r ON r.file_id = h.node AND r.target IS NOT NULL WHERE h.depth < 3
) SELECT s.relative_path AS q, t.relative_path AS path, min(depth) AS depth FROM reach JOIN fx_files s ON s.file_id = start JOIN fx_files t ON t.file_id = node WHERE node <> start GROUP BY 1, 2""", True)
def transitive_dependencies(spark, d):
    sources = testdata.sources(spark, d)
    files = testdata.files(spark, d)
    includes = link.resolve_includes(extract.extract_includes(sources), files)
    return graph.transitive_dependencies(includes, files, files.select("relative_path"))


@query(f"WITH {_RESOLVED} SELECT codebase_id, CAST(count(target) AS BIGINT) AS resolved, CAST(count(*) - count(target) AS BIGINT) AS unresolved FROM resolved WHERE is_system = 0 GROUP BY 1")
def resolution_rate(spark, d):
    includes, _ = _includes(spark, d)
    return link.resolution_rate(includes, ["codebase_id"])


# macros and reports ----------------------------------------------------------------------------------

_SPEC = "string_agg(CASE WHEN s.value IS NULL THEN s.key ELSE s.key || '=' || s.value END, ', ' ORDER BY s.ord)"


@query("""SELECT m.file_id, m.line_number, macro_type, arg_min(s.name, s.line_start * 10 + s.ord) AS symbol_name FROM fx_macros m LEFT JOIN fx_symbols s
  ON s.file_id = m.file_id AND s.line_start BETWEEN m.line_number AND m.line_number + 10
  AND CASE WHEN macro_type = 'UCLASS' THEN s.kind = 'class' WHEN macro_type = 'GENERATED_BODY' THEN true ELSE s.kind IN ('method', 'field') END GROUP BY 1, 2, 3""")
def attach_macro_symbol(spark, d):
    symbols = testdata.symbols(spark, d)
    out = macros.attach_macro_symbol(testdata.macros(spark, d), symbols)
    return out.join(symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name")), "symbol_id", "left").select("file_id", "line_number", "macro_type", "symbol_name")


@query(f"SELECT file_id, line_number, {_SPEC} AS specifiers FROM fx_specifiers s GROUP BY 1, 2")
def concat_specifiers(spark, d):
    out = macros.concat_specifiers(testdata.specifiers(spark, d)).withColumnRenamed("macro_id", "id")
    return out.join(testdata.macros(spark, d), "id").select("file_id", "line_number", "specifiers")


@query(f"""SELECT macro_type, relative_path AS path, m.line_number, y.name AS symbol_name, y.kind AS symbol_kind, {_SPEC} AS specifiers
FROM (SELECT * FROM fx_macros JOIN fx_files USING (file_id) WHERE macro_type = 'UPROPERTY' AND codebase_id = 2 ORDER BY relative_path, line_number LIMIT 50) m
JOIN fx_symbols y ON y.file_id = m.file_id AND y.ord = m.sym_ord JOIN fx_specifiers s ON s.file_id = m.file_id AND s.line_number = m.line_number GROUP BY 1, 2, 3, 4, 5""")
def find_macros(spark, d):
    return macros.find_macros(testdata.macros(spark, d), testdata.specifiers(spark, d), testdata.symbols(spark, d), testdata.files(spark, d), macro_type="UPROPERTY", specifier="BlueprintReadWrite", codebase_id=2)


@query(f"""SELECT y.name AS q, macro_type, m.line_number, coalesce({_SPEC} FILTER (s.is_meta = 0), '') AS ordinary, coalesce({_SPEC} FILTER (s.is_meta = 1), '') AS meta
FROM fx_macros m JOIN fx_symbols y ON y.file_id = m.file_id AND y.ord = m.sym_ord LEFT JOIN fx_specifiers s ON s.file_id = m.file_id AND s.line_number = m.line_number
WHERE y.name IN ('APart3', 'Run4', 'Price5', 'APart77') GROUP BY 1, 2, 3""")
def macro_specifiers(spark, d):
    out = macros.macro_specifiers(testdata.macros(spark, d), testdata.specifiers(spark, d), testdata.symbols(spark, d), ["APart3", "Run4", "Price5", "APart77"])
    return out.select("q", "macro_type", "line_number", F.array_join("ordinary", ", ").alias("ordinary"), F.array_join("meta", ", ").alias("meta"))


@query(f"SELECT m.file_id, macro_type, m.line_number, {_SPEC} AS specifiers FROM fx_macros m LEFT JOIN fx_specifiers s ON s.file_id = m.file_id AND s.line_number = m.line_number GROUP BY 1, 2, 3")
def macros_by_file(spark, d):
    ids = testdata.files(spark, d).select("file_id")
    return macros.macros_by(testdata.macros(spark, d), testdata.specifiers(spark, d), file_ids=ids).select("file_id", "macro_type", "line_number", "specifiers")


@query("""SELECT relative_path AS path, m.line_number, macro_type, y.name AS symbol_name, y.kind AS symbol_kind, CASE macro_type WHEN 'UCLASS' THEN 'Blueprintable' WHEN 'UFUNCTION' THEN 'BlueprintCallable' ELSE 'BlueprintReadWrite' END AS keys
FROM fx_macros m JOIN fx_files f ON f.file_id = m.file_id JOIN fx_symbols y ON y.file_id = m.file_id AND y.ord = m.sym_ord
WHERE codebase_id = 1 AND macro_type <> 'GENERATED_BODY' ORDER BY relative_path, m.line_number LIMIT 100""")
def blueprint_exposed(spark, d):
    out = reports.blueprint_exposed(testdata.macros(spark, d), testdata.specifiers(spark, d), testdata.symbols(spark, d), testdata.files(spark, d), 1)
    return out.withColumn("keys", F.array_join("keys", ", "))


def _class_names(spark: SparkSession, d: str) -> DataFrame:
    return testdata.view(spark, d, "fx_class").select("class_name")


@query("""SELECT class_name AS q, true AS is_blueprintable, false AS is_blueprint_type, 'function' AS section, 'Run' || pk AS symbol_name, 11 AS line_start, 'BlueprintCallable, Category=' || p_brand AS specifiers FROM fx_class
UNION ALL SELECT class_name, true, false, 'property', 'Price' || pk, 13, 'EditAnywhere, BlueprintReadWrite, ClampMin=' || p_size FROM fx_class""")
def blueprint_interface(spark, d):
    return reports.blueprint_interface(testdata.symbols(spark, d), testdata.macros(spark, d), testdata.specifiers(spark, d), testdata.files(spark, d), _class_names(spark, d))


@query("""SELECT class_name AS q, 'class' AS section, 6 AS ord, 'class' AS name, module || '/Public/Part' || pk || '.h' AS detail, NULL AS modifiers, NULL AS signature FROM fx_class
UNION ALL SELECT class_name, 'naming', 0, 'A', 'Actor subclass', NULL, NULL FROM fx_class UNION ALL SELECT class_name, 'base', 0, parent_name, 'public', NULL, NULL FROM fx_class
UNION ALL SELECT class_name, 'macro', 5, 'UCLASS', 'Blueprintable, ClassGroup=' || p_type || ', DisplayName=' || p_name, NULL, NULL FROM fx_class
UNION ALL SELECT class_name, 'method', 11, 'Run' || pk, 'GENERATED_BODY() UFUNCTION(BlueprintCallable, Category=' || p_brand || ')', 'public virtual', 'void Run' || pk || '(int32 Size)' FROM fx_class
UNION ALL SELECT class_name, 'field', 13, 'Price' || pk, 'UPROPERTY(EditAnywhere, BlueprintReadWrite, ClampMin=' || p_size || ')', 'public', 'float Price' || pk FROM fx_class""")
def analyze_class(spark, d):
    return reports.analyze_class(testdata.symbols(spark, d), testdata.inheritance(spark, d), testdata.macros(spark, d), testdata.specifiers(spark, d), testdata.files(spark, d), _class_names(spark, d))


@query("""SELECT codebase_id, count(DISTINCT f.file_id) AS n_files, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS n_symbols, CAST(sum(coalesce(m.n, 0)) AS BIGINT) AS n_macros FROM fx_files f
LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_symbols GROUP BY 1) s ON s.file_id = f.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_macros GROUP BY 1) m ON m.file_id = f.file_id GROUP BY 1""")
def index_status(spark, d):
    files = testdata.files(spark, d)
    return reports.index_status(files.select("codebase_id").distinct(), files, testdata.symbols(spark, d), testdata.macros(spark, d))


# snapshots ---------------------------------------------------------------------------------------------

_OLD = "old AS (SELECT source, doc_id, doc_id * 1000.0 AS mtime, text FROM documents WHERE doc_id % 10 <> 0)"
_NEW = """new AS (SELECT source, doc_id, doc_id * 1000.0 + CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 5000 WHEN doc_id % 11 = 0 THEN 500 ELSE 0 END AS mtime,
  CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)"""
_STATUS = f"""{_OLD}, {_NEW}, status AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.doc_id, n.doc_id) AS doc_id,
  CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN abs(n.mtime - o.mtime) > 1000 AND sha256(n.text) <> sha256(o.text) THEN 'changed' ELSE 'unchanged' END AS status
  FROM old o FULL JOIN new n ON n.source = o.source AND n.doc_id = o.doc_id)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, d, "documents").select("source", "doc_id", "text")
    old = docs.filter("doc_id % 10 <> 0").select("source", "doc_id", (F.col("doc_id") * 1000.0).alias("mtime"), F.sha2("text", 256).alias("content_hash"), "text")
    late = F.when((F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 5 == 0), 5000).when(F.col("doc_id") % 11 == 0, 500).otherwise(0)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    new = docs.filter("doc_id % 10 <> 1").select("source", "doc_id", (F.col("doc_id") * 1000.0 + late).alias("mtime"), F.sha2(text, 256).alias("content_hash"), text.alias("text"))
    return old, new


@query(f"WITH {_STATUS} SELECT * FROM status")
def detect_changes(spark, d):
    old, new = _snapshots(spark, d)
    return changes.detect_changes(old, new, keys=("source", "doc_id"))


@query(f"""WITH {_STATUS} SELECT source, CAST(count(*) FILTER (status <> 'deleted') AS BIGINT) AS total_files, CAST(count(*) FILTER (status = 'new') AS BIGINT) AS new_files, CAST(count(*) FILTER (status = 'changed') AS BIGINT) AS changed_files,
CAST(count(*) FILTER (status = 'unchanged') AS BIGINT) AS unchanged_files, CAST(count(*) FILTER (status = 'deleted') AS BIGINT) AS deleted_files,
CAST((SELECT count(*) FROM new WHERE new.source = status.source) AS BIGINT) AS symbols, CAST((SELECT coalesce(sum(length(text) - length(replace(text, 'a', ''))), 0) FROM new WHERE new.source = status.source) AS BIGINT) AS references_table FROM status GROUP BY source""")
def index_summary(spark, d):
    new = _snapshots(spark, d)[1]
    letters = new.select("source", F.explode(F.sequence(F.lit(0), F.length("text") - F.length(F.replace("text", F.lit("a"), F.lit(""))))).alias("n")).filter("n > 0")
    return changes.index_summary(detect_changes(spark, d), by=["source"], symbols=new.select("source"), references_table=letters)


def _snapshot_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """files and one reference for each word count, as a small index."""
    base = F.regexp_replace("source", "src", "").cast("long")
    files = rows.select(file_id(base, F.col("doc_id").cast("string")).alias("id"), base.alias("codebase_id"), F.col("doc_id").cast("string").alias("relative_path"), "content_hash")
    symbols = files.select(F.xxhash64("id").alias("id"), F.col("id").alias("file_id"), F.concat(F.lit("S"), "relative_path").alias("name"))
    return {"files": files, "symbols": symbols}


@query(f"""WITH {_STATUS} SELECT CAST(substr(s.source, 4) AS BIGINT) AS codebase_id, CAST(s.doc_id AS VARCHAR) AS relative_path, sha256(CASE WHEN status = 'unchanged' THEN o.text ELSE n.text END) AS content_hash, 'S' || s.doc_id AS name
FROM status s LEFT JOIN old o ON o.doc_id = s.doc_id LEFT JOIN new n ON n.doc_id = s.doc_id WHERE status <> 'deleted'""")
def apply_changes(spark, d):
    old, new = _snapshots(spark, d)
    found = changes.detect_changes(old, new, keys=("source", "doc_id")).select(F.regexp_replace("source", "src", "").cast("long").alias("codebase_id"), F.col("doc_id").cast("string").alias("relative_path"), "status")
    fresh_keys = found.filter(F.col("status").isin("new", "changed"))
    fresh = _snapshot_tables(new)
    fresh["files"] = fresh["files"].join(fresh_keys, ["codebase_id", "relative_path"], "left_semi")
    fresh["symbols"] = fresh["symbols"].join(fresh["files"].select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id", "file_id", "name")
    out = changes.apply_changes(_snapshot_tables(old), found, fresh)
    return out["files"].join(out["symbols"].select(F.col("file_id").alias("id"), "name"), "id").select("codebase_id", "relative_path", "content_hash", "name")


@query(f"""WITH {_CALLEES}
SELECT c.file_id, line_number, caller_name, callee_name, coalesce(
  CASE WHEN q.qualified_name IS NULL THEN NULL ELSE q.qualified_name || '@' || f.relative_path || ':' || q.line_start END, k.target) AS target
FROM fx_calls c JOIN fx_files f ON f.file_id = c.file_id LEFT JOIN fx_symbols q ON q.file_id = c.file_id AND q.name = c.callee_name
LEFT JOIN callees k ON k.codebase_id = f.codebase_id AND k.name = c.callee_name""")
def relink_changed_files(spark, d):
    """One file in seven is taken anew, with other symbol ids: all calls into it are linked again, as if all had been indexed at once."""
    calls, symbols, files = _calls(spark, d)
    old = {"files": files, "symbols": symbols, "calls": calls}
    some = files.filter("file_id % 7 = 0")
    new_id = F.xxhash64("id", F.lit("new"))
    fresh_symbols = symbols.join(some.select("file_id"), "file_id", "left_semi").withColumn("id", new_id)
    fresh_calls = link.resolve_names_in_file(testdata.calls(spark, d).join(some.select("file_id"), "file_id", "left_semi"), fresh_symbols)
    found = some.select("codebase_id", "relative_path", F.lit("changed").alias("status"))
    out = changes.apply_changes(old, found, {"files": some, "symbols": fresh_symbols, "calls": fresh_calls})
    at = out["symbols"].join(files, "file_id").select(F.col("id").alias("callee_symbol_id"), F.concat("qualified_name", F.lit("@"), "relative_path", F.lit(":"), "line_start").alias("target"))
    return out["calls"].join(at, "callee_symbol_id", "left").select("file_id", "line_number", "caller_name", "callee_name", "target")


@query(f"""WITH {_CALLEES}, added AS (SELECT codebase_id, 'Run' || pk AS name FROM fx_class WHERE pk % 5 = 0)
SELECT c.file_id, line_number, caller_name, c.callee_name, coalesce(
  CASE WHEN q.qualified_name IS NULL THEN NULL ELSE q.qualified_name || '@' || f.relative_path || ':' || q.line_start END, 'Added::' || a.name || '@AAA/Added.cpp:1', k.target) AS target
FROM fx_calls c JOIN fx_files f ON f.file_id = c.file_id LEFT JOIN fx_symbols q ON q.file_id = c.file_id AND q.name = c.callee_name
LEFT JOIN added a ON a.codebase_id = f.codebase_id AND a.name = c.callee_name LEFT JOIN callees k ON k.codebase_id = f.codebase_id AND k.name = c.callee_name""")
def relink_added_files(spark, d):
    """A file that sorts first is added to each codebase, with a function for every fifth class: links that held until now move to it, as in a full run."""
    calls, symbols, files = _calls(spark, d)
    fresh = files.select("codebase_id").distinct().select((-1000 - F.col("codebase_id")).alias("file_id"), "codebase_id", F.lit("AAA/Added.cpp").alias("relative_path"))
    rows = fresh.join(_read(spark, d, "part").filter("p_partkey % 5 = 0").select((1 + F.col("p_size") % 3).alias("codebase_id"), F.col("p_partkey").cast("int").alias("ord")), "codebase_id")
    name = F.concat(F.lit("Run"), "ord")
    rows = rows.select("file_id", "ord", symbol_id(F.col("file_id"), F.col("ord")).alias("id"), name.alias("name"), F.concat(F.lit("Added::"), name).alias("qualified_name"), F.lit("function").alias("kind"), F.lit(1).cast("long").alias("line_start"))
    found = fresh.select("codebase_id", "relative_path", F.lit("new").alias("status"))
    out = changes.apply_changes({"files": files, "symbols": symbols, "calls": calls}, found, {"files": fresh, "symbols": rows})
    at = out["symbols"].join(out["files"], "file_id").select(F.col("id").alias("callee_symbol_id"), F.concat("qualified_name", F.lit("@"), "relative_path", F.lit(":"), "line_start").alias("target"))
    return out["calls"].join(at, "callee_symbol_id", "left").select("file_id", "line_number", "caller_name", "callee_name", "target")


@query("""SELECT v AS version, s.file_id, f.codebase_id, name, kind FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id, (VALUES (1), (2)) t(v) WHERE v = 1 OR f.codebase_id <> 2 OR s.file_id % 7 <> 0""")
def index_versions(spark, d):
    """An index read, changed and written back in place: one codebase loses a seventh of its files, and both versions can be read."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    store.write_index({"files": testdata.files(spark, d), "symbols": testdata.symbols(spark, d)}, folder)
    own = store.read_index(spark, folder, ["files", "symbols"], 1, codebase_ids=[2])
    store.write_index(changes.delete_files(own, own["files"].filter("file_id % 7 = 0").select("file_id")), folder, based_on=1)
    read = lambda n: store.read_index(spark, folder, ["symbols"], n)["symbols"].select(F.lit(n).alias("version"), "file_id", "codebase_id", "name", "kind")
    return read(1).unionByName(read(2))


@query("""SELECT c.file_id, line_number, caller_name, callee_name, q.file_id % 7 <> 0 AS linked FROM fx_calls c LEFT JOIN (SELECT file_id, 'Run' || ((file_id - 1) // 2) AS name FROM fx_symbols WHERE file_id % 2 = 1) q ON q.name = c.callee_name WHERE c.file_id % 7 <> 0""")
def delete_files(spark, d):
    files, symbols = testdata.files(spark, d), testdata.symbols(spark, d)
    target = symbols.filter("file_id % 2 = 1").select(F.col("name").alias("callee_name"), F.col("id").alias("callee_symbol_id"))
    owner = symbols.filter("file_id % 2 = 1").select("file_id", F.col("id").alias("caller_symbol_id"))
    calls = testdata.calls(spark, d).join(target, "callee_name", "left").join(owner, "file_id")
    out = changes.delete_files({"files": files.withColumnRenamed("file_id", "id"), "symbols": symbols, "calls": calls}, files.filter("file_id % 7 = 0").select("file_id"))
    return out["calls"].select("file_id", "line_number", "caller_name", "callee_name", F.col("callee_symbol_id").isNotNull().alias("linked"))


@query("SELECT s.file_id, s.name, s.kind FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id WHERE f.codebase_id <> 2")
def delete_codebases(spark, d):
    files = testdata.files(spark, d).withColumnRenamed("file_id", "id")
    bases = files.select(F.col("codebase_id").alias("id")).distinct()
    out = changes.delete_codebases({"codebases": bases, "files": files, "symbols": testdata.symbols(spark, d)}, F.col("id") == 2)
    return out["symbols"].select("file_id", "name", "kind")


@query("""SELECT coalesce(n.source, o.source) AS root_path, CASE WHEN n.source IS NULL THEN 'project' ELSE 'engine' END AS type, CAST(coalesce(o.m, n.m) AS BIGINT) AS created FROM
(SELECT source, min(doc_id) AS m FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) o FULL JOIN (SELECT source, max(doc_id) AS m FROM documents WHERE doc_id % 4 = 1 GROUP BY 1) n ON n.source = o.source""")
def register_codebases(spark, d):
    docs = _read(spark, d, "documents").select("source", "doc_id")
    shape = lambda rows, pick, kind: rows.groupBy("source").agg(pick("doc_id").alias("m")).select(F.xxhash64("source").alias("id"), F.col("source").alias("name"), F.col("source").alias("root_path"), F.lit(kind).alias("type"), F.timestamp_seconds("m").alias("created_at"))
    out = corpus.register_codebases(shape(docs.filter("doc_id % 3 = 0"), F.min, "project"), shape(docs.filter("doc_id % 4 = 1"), F.max, "engine"))
    return out.select("root_path", "type", F.unix_seconds("created_at").alias("created"))


# lookups --------------------------------------------------------------------------------------------------


@query("SELECT file_id, name, kind, line_start FROM fx_symbols")
def symbols_by_file(spark, d):
    symbols = testdata.symbols(spark, d)
    return reports.symbols_by_file(symbols, testdata.files(spark, d).select("file_id")).select("file_id", "name", "kind", "line_start")


@query("SELECT name, qualified_name, codebase_id, relative_path AS path, line_start FROM fx_symbols JOIN fx_files USING (file_id)")
def symbols_by_name(spark, d):
    symbols = testdata.symbols(spark, d)
    return reports.symbols_by_name(symbols, testdata.files(spark, d), symbols.select("name")).select("name", "qualified_name", "codebase_id", "path", "line_start")


@query("SELECT name, relative_path AS path, line_start FROM fx_symbols JOIN fx_files USING (file_id) WHERE kind = 'field' AND codebase_id = 3 ORDER BY path, line_start, name LIMIT 50")
def symbols_by_kind(spark, d):
    return reports.symbols_by_kind(testdata.symbols(spark, d), testdata.files(spark, d), "field", 3).select("name", "path", "line_start")


@query("SELECT class_name AS parent, n AS name, k AS kind FROM (SELECT class_name, 'Run' || pk AS n, 'method' AS k FROM fx_class UNION ALL SELECT class_name, 'Price' || pk, 'field' FROM fx_class)")
def members_of(spark, d):
    symbols = testdata.symbols(spark, d)
    classes = symbols.filter("kind = 'class'").select("id", F.col("name").alias("parent"))
    out = reports.members_of(symbols, classes.select("id"))
    return out.join(classes.withColumnRenamed("id", "parent_symbol_id"), "parent_symbol_id").select("parent", "name", "kind")


@query("SELECT file_id, codebase_id, relative_path FROM fx_files WHERE codebase_id = 2")
def files_of_codebase(spark, d):
    return reports.files_of_codebase(testdata.files(spark, d), 2)


# extraction from rendered text ----------------------------------------------------------------------------------


@query("""SELECT s.file_id, s.ord, s.name, qualified_name, kind, line_start, CASE kind WHEN 'class' THEN 14 WHEN 'method' THEN CASE WHEN s.file_id % 2 = 0 THEN 11 ELSE 5 + n_calls END ELSE 13 END AS line_end,
  CASE WHEN s.ord > 0 THEN 4 ELSE 0 END AS column_start, CASE WHEN s.ord > 0 THEN 'public' END AS access, s.ord = 1 AS is_virtual, false AS is_static, false AS is_const, false AS is_inline,
  CASE kind WHEN 'method' THEN 'void' WHEN 'field' THEN 'float' END AS return_type, CASE WHEN s.ord > 0 THEN 0 END AS parent_ord,
  CASE kind WHEN 'class' THEN 'class ' || class_name || ' : public ' || parent_name WHEN 'method' THEN 'void ' || CASE WHEN s.file_id % 2 = 0 THEN s.name ELSE qualified_name END || '(int32 Size)' END AS signature,
  CASE kind WHEN 'class' THEN regexp_extract(h.text, '(class MOD_API .*});', 1, 's') WHEN 'field' THEN 'float ' || s.name || ';' ELSE
    CASE WHEN s.file_id % 2 = 0 THEN 'virtual void ' || s.name || '(int32 Size);' WHEN length(c.body) > 500 THEN substr(c.body, 1, 500) || '...' ELSE c.body END END AS raw_text
  FROM fx_symbols s LEFT JOIN fx_header h ON h.file_id = s.file_id LEFT JOIN fx_cpp c ON c.file_id = s.file_id JOIN fx_class p ON p.pk = s.file_id // 2""")
def extract_symbols(spark, d):
    out = extract.extract_symbols(extract.scan_sources(testdata.sources(spark, d)))
    return out.select("file_id", "ord", "name", "qualified_name", "kind", "line_start", "line_end", "column_start", "access", "is_virtual", "is_static", "is_const", "is_inline", "return_type", "parent_ord", "signature", "raw_text")


@query("SELECT file_id, name AS function_name, 'Size' AS name, 'int32' AS type, 0 AS position FROM fx_symbols WHERE kind = 'method'")
def explode_parameters(spark, d):
    symbols = extract.extract_symbols(extract.scan_sources(testdata.sources(spark, d)))
    return extract.explode_parameters(symbols).join(symbols.select(F.col("id").alias("symbol_id"), "file_id", F.col("name").alias("function_name")), "symbol_id").select("file_id", "function_name", "name", "type", "position")


@query("SELECT 'Size' AS name, 'int32' AS type, 0 AS position, file_id FROM fx_symbols WHERE kind = 'method'")
def parameters_of(spark, d):
    symbols = extract.extract_symbols(extract.scan_sources(testdata.sources(spark, d)))
    out = reports.parameters_of(extract.explode_parameters(symbols), symbols.select("id"))
    return out.join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").select("name", "type", "position", "file_id")


@query("SELECT child_name, parent_name, access, false AS is_virtual FROM fx_inheritance")
def explode_base_classes(spark, d):
    return extract.explode_base_classes(extract.extract_symbols(extract.scan_sources(testdata.sources(spark, d)))).select("child_name", "parent_name", "access", "is_virtual")


@query("SELECT file_id, line_number, included_path, is_system = 1 AS is_system FROM fx_includes")
def extract_includes(spark, d):
    return extract.extract_includes(testdata.sources(spark, d)).select("file_id", "line_number", "included_path", "is_system")


@query("SELECT m.file_id, line_number, macro_type, trim(string_split(text, chr(10))[line_number]) AS raw_text FROM fx_macros m JOIN fx_header h ON h.file_id = m.file_id")
def extract_macros(spark, d):
    return extract.extract_macros(testdata.sources(spark, d)).select("file_id", "line_number", "macro_type", "raw_text")


@query("SELECT file_id, line_number, ord, key, value, is_meta = 1 AS is_meta FROM fx_specifiers")
def parse_specifiers(spark, d):
    found = extract.extract_macros(testdata.sources(spark, d))
    return extract.explode_specifiers(found).join(found.select(F.col("id").alias("macro_id"), "file_id", "line_number"), "macro_id").select("file_id", "line_number", "ord", "key", "value", "is_meta")


@query(r"""SELECT file_id, replace(regexp_replace(text, '\n *(UCLASS|GENERATED_BODY|UFUNCTION|UPROPERTY)\([^\n]*', chr(10), 'g'), 'MOD_API', '') AS clean_text FROM fx_header
UNION ALL SELECT file_id, head || body || chr(10) FROM fx_cpp""")
def clean_source(spark, d):
    return extract.clean_source(testdata.sources(spark, d)).select("file_id", "clean_text")


@query("SELECT file_id, line_number, callee_name, caller_name FROM fx_calls")
def extract_calls(spark, d):
    scanned = extract.scan_sources(testdata.sources(spark, d))
    return extract.extract_calls(scanned, extract.extract_symbols(scanned)).select("file_id", "line_number", "callee_name", "caller_name")


@query("SELECT file_id, line_number, callee_name, caller_name FROM fx_calls")
def attach_enclosing_function(spark, d):
    symbols = extract.extract_symbols(extract.scan_sources(testdata.sources(spark, d)))
    items = testdata.calls(spark, d).select("file_id", "line_number", "callee_name")
    return link.attach_enclosing_function(items, symbols).select("file_id", "line_number", "callee_name", "caller_name")


_REFS = """refs AS (SELECT pk * 2 AS file_id, class_name AS symbol_name, 6 AS line_number, 14 AS column_number, 'class MOD_API ' || class_name || ' : public ' || parent_name AS context FROM fx_class
UNION ALL SELECT pk * 2, class_name, 6, 24 + length(class_name), 'class MOD_API ' || class_name || ' : public ' || parent_name FROM fx_class WHERE class_name = parent_name
UNION ALL SELECT pk * 2 + 1, 'Run' || pk, 3, 7 + length(class_name), 'void ' || class_name || '::Run' || pk || '(int32 Size)' FROM fx_class
UNION ALL SELECT file_id, callee_name, line_number, 4, callee_name || '();' FROM fx_calls WHERE callee_name = 'Run' || ((file_id - 1) // 2))"""


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sources = testdata.sources(spark, d)
    scanned = extract.scan_sources(sources)
    symbols = extract.extract_symbols(scanned)
    return extract.extract_references(scanned, symbols), symbols, testdata.files(spark, d)


@query(f"WITH {_REFS} SELECT * FROM refs")
def extract_references(spark, d):
    return _references(spark, d)[0].select("file_id", "symbol_name", "line_number", "column_number", "context")


@query(f"""WITH {_REFS}, first AS (SELECT codebase_id, name, arg_min(qualified_name || '@' || relative_path, relative_path || '#' || ord) AS target FROM fx_symbols JOIN fx_files USING (file_id) GROUP BY 1, 2)
SELECT r.file_id, symbol_name, line_number, column_number, target FROM refs r JOIN fx_files f ON f.file_id = r.file_id LEFT JOIN first t ON t.codebase_id = f.codebase_id AND t.name = r.symbol_name""")
def resolve_references(spark, d):
    refs, symbols, files = _references(spark, d)
    at = symbols.join(files.select("file_id", "relative_path"), "file_id").select(F.col("id").alias("symbol_id"), F.concat("qualified_name", F.lit("@"), "relative_path").alias("target"))
    return link.resolve_references(refs, symbols, files).join(at, "symbol_id", "left").select("file_id", "symbol_name", "line_number", "column_number", "target")


@query(f"WITH {_REFS} SELECT symbol_name AS q, relative_path AS path, line_number, column_number, context, kind FROM refs JOIN fx_files USING (file_id) JOIN (SELECT DISTINCT name, kind FROM fx_symbols) s ON s.name = symbol_name")
def find_references(spark, d):
    refs, symbols, files = _references(spark, d)
    return search.find_references(link.resolve_references(refs, symbols, files), symbols, files, symbols.select("name"), limit=None)


@query(f"WITH {_REFS} SELECT file_id, symbol_name, line_number FROM refs")
def references_by_file(spark, d):
    refs, symbols, files = _references(spark, d)
    ids = files.select("file_id")
    return reports.references_by_file(link.resolve_references(refs, symbols, files), symbols, ids).select("file_id", "symbol_name", "line_number")


@query(f"""WITH {_REFS}, {_CALLEES}, {_RESOLVED}, located AS (SELECT s.*, f.codebase_id, f.relative_path FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id),
named_any AS (SELECT codebase_id, name, arg_min(qualified_name || '@' || relative_path, relative_path || '#' || ord) AS target FROM located GROUP BY 1, 2),
owner AS (SELECT m.file_id, m.line_number, macro_type, s.name FROM fx_macros m JOIN fx_symbols s ON s.file_id = m.file_id AND s.ord = m.sym_ord),
facts AS (
  SELECT 'files' AS table_name, concat_ws('|', file_id, codebase_id, relative_path) AS fact FROM fx_files WHERE file_id >= 0
  UNION ALL SELECT 'symbols', concat_ws('|', file_id, ord, name, qualified_name, kind, line_start) FROM fx_symbols
  UNION ALL SELECT 'parameters', concat_ws('|', file_id, name, 'Size', 'int32', 0) FROM fx_symbols WHERE kind = 'method'
  UNION ALL SELECT 'inheritance', concat_ws('|', c.class_name, c.parent_name, 'public', CASE WHEN p.codebase_id = c.codebase_id THEN p.pk * 2 END) FROM fx_class c LEFT JOIN fx_class p ON p.class_name = c.parent_name
  UNION ALL SELECT 'ue_macros', concat_ws('|', file_id, line_number, macro_type, name) FROM owner
  UNION ALL SELECT 'ue_macro_specifiers', concat_ws('|', file_id, line_number, ord, key, value, is_meta) FROM fx_specifiers
  UNION ALL SELECT 'calls', concat_ws('|', c.file_id, line_number, caller_name, callee_name, coalesce(q.qualified_name || '@' || f.relative_path || ':' || q.line_start, k.target)) FROM fx_calls c JOIN fx_files f ON f.file_id = c.file_id
    LEFT JOIN fx_symbols q ON q.file_id = c.file_id AND q.name = c.callee_name LEFT JOIN callees k ON k.codebase_id = f.codebase_id AND k.name = c.callee_name
  UNION ALL SELECT 'includes', concat_ws('|', r.file_id, line_number, included_path, is_system, CASE WHEN r.target >= 0 THEN r.target END) FROM resolved r WHERE r.file_id >= 0
  UNION ALL SELECT 'references_table', concat_ws('|', r.file_id, symbol_name, line_number, column_number, context, t.target) FROM refs r JOIN fx_files f ON f.file_id = r.file_id LEFT JOIN named_any t ON t.codebase_id = f.codebase_id AND t.name = r.symbol_name
) SELECT table_name, count(*) AS n, CAST(sum(CAST(concat('0x', substr(md5(fact), 1, 8)) AS BIGINT)) AS BIGINT) AS content FROM facts GROUP BY 1""")
def index_corpus(spark, d):
    """Rows of each table, and a sum over hashes of their contents with the links written as names."""
    sources = testdata.sources(spark, d).unionByName(testdata.files(spark, d).filter("file_id < 0").withColumn("content", F.lit("#pragma once\n")))
    t = extract.index_corpus(sources)
    files, symbols = t["files"], t["symbols"]
    at = symbols.join(files.select("file_id", "relative_path"), "file_id").select(F.col("id").alias("at_id"), F.col("file_id").alias("at_file"), F.col("name").alias("at_name"), F.concat("qualified_name", F.lit("@"), "relative_path").alias("place"), F.concat("qualified_name", F.lit("@"), "relative_path", F.lit(":"), "line_start").alias("line"))

    def linked(name: str, column: str) -> DataFrame:
        return t[name].join(at, F.col(column) == F.col("at_id"), "left")

    rows = {
        "files": files.filter("file_id >= 0").select("file_id", "codebase_id", "relative_path"), "symbols": symbols.select("file_id", "ord", "name", "qualified_name", "kind", "line_start"),
        "parameters": linked("parameters", "symbol_id").select("at_file", "at_name", "name", "type", "position"), "inheritance": linked("inheritance", "parent_symbol_id").select("child_name", "parent_name", "access", "at_file"),
        "ue_macros": linked("ue_macros", "symbol_id").select("file_id", "line_number", "macro_type", "at_name"),
        "ue_macro_specifiers": t["ue_macro_specifiers"].join(t["ue_macros"].select(F.col("id").alias("macro_id"), "file_id", "line_number"), "macro_id").select("file_id", "line_number", "ord", "key", "value", F.col("is_meta").cast("int")),
        "calls": linked("calls", "callee_symbol_id").select("file_id", "line_number", "caller_name", "callee_name", "line"), "includes": t["includes"].select("file_id", "line_number", "included_path", F.col("is_system").cast("int"), F.when(F.col("resolved_file_id") >= 0, F.col("resolved_file_id"))),
        "references_table": linked("references_table", "symbol_id").select("file_id", "symbol_name", "line_number", "column_number", "context", "place"),
    }
    out = None
    for name, table in rows.items():
        fact = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in table.columns])
        number = F.conv(F.substring(F.md5(fact), 1, 8), 16, 10).cast("long")
        part = table.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(number).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


# search -------------------------------------------------------------------------------------------------------------


def _part_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"), F.col("p_type").alias("kind"), F.lit(None).cast("string").alias("signature"))


#: the tables' words and the queries' that a published stemmer changes
_STEM = "CASE {0} WHEN 'large' THEN 'larg' WHEN 'economy' THEN 'economi' WHEN 'words' THEN 'word' WHEN 'gears' THEN 'gear' ELSE {0} END"
_TOKENS = f"""tokens AS (SELECT id, c, {_STEM.format("raw")} AS token FROM (SELECT id, c, unnest(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '')) AS raw FROM (
  SELECT p_partkey AS id, 'name' AS c, p_name AS t FROM part UNION ALL SELECT p_partkey, 'qualified_name', p_brand || '::' || p_name FROM part UNION ALL SELECT p_partkey, 'kind', p_type FROM part))),
tf AS (SELECT id, token, count(*) AS tf, count(*) FILTER (c = 'name') AS tf_name, count(*) FILTER (c = 'qualified_name') AS tf_qualified_name, count(*) FILTER (c = 'kind') AS tf_kind FROM tokens GROUP BY 1, 2),
sized AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY id) AS BIGINT) AS length FROM tf)"""


@query(f"WITH {_TOKENS} SELECT id AS symbol_id, token, tf, tf_name, tf_qualified_name, tf_kind, length FROM sized")
def build_symbol_index(spark, d):
    return search.build_symbol_index(_part_symbols(spark, d)).select("symbol_id", "token", "tf", "tf_name", "tf_qualified_name", "tf_kind", "length")


_SEARCHES = ["STANDARD", "brand 1", "pro*", "small bru", "no such words", "large economy", "gears"]


@query(f"""WITH {_TOKENS}, terms AS (SELECT q, n, {_STEM.format("raw")} AS term FROM (SELECT q, len(w) AS n, unnest(w) AS raw FROM (SELECT q, list_distinct(regexp_split_to_array(lower(replace(q, '*', '')), ' ')) AS w FROM (VALUES ('STANDARD'), ('brand 1'), ('pro*'), ('small bru'), ('no such words'), ('large economy'), ('gears')) v(q)))),
hit AS (SELECT q, n, term, id, length, sum(tf) AS tf FROM sized JOIN terms ON starts_with(token, term) GROUP BY 1, 2, 3, 4, 5),
df AS (SELECT q, term, count(*) AS df FROM hit GROUP BY 1, 2), scale AS (SELECT count(*) AS na, avg(length) AS al FROM (SELECT DISTINCT id, length FROM sized)),
ranked AS (SELECT q, n, id, count(*) AS found, -sum(greatest(ln((na - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS rank FROM hit JOIN df USING (q, term), scale GROUP BY 1, 2, 3)
SELECT q, symbol_id, name, kind, rank FROM (SELECT q, id AS symbol_id, p_name AS name, p_type AS kind, round(rank, 6) AS rank, row_number() OVER (PARTITION BY q ORDER BY round(rank, 6), p_name, id) AS k
  FROM ranked JOIN part ON p_partkey = id WHERE found = n) WHERE k <= 50""")
def search_symbols(spark, d):
    symbols = _part_symbols(spark, d)
    return search.search_symbols(search.build_symbol_index(symbols), symbols, None, _SEARCHES).select("q", "symbol_id", "name", "kind", "rank")


@query("""SELECT q, symbol_id, name FROM (SELECT q, p_partkey AS symbol_id, p_name AS name, row_number() OVER (PARTITION BY q ORDER BY p_name, p_partkey) AS k FROM part, (VALUES ('#1'), ('d#2'), ('zzz')) v(q)
WHERE p_name ILIKE '%' || q || '%' OR p_brand || '::' || p_name ILIKE '%' || q || '%') WHERE k <= 50""")
def search_symbols_fallback(spark, d):
    return search.search_symbols_fallback(_part_symbols(spark, d), ["#1", "d#2", "zzz"]).select("q", "symbol_id", "name")


@query(f"""WITH {_TOKENS}, hit AS (SELECT q, id, length, sum(tf) AS tf FROM sized JOIN (VALUES ('STANDARD', 'standard'), ('rand#', 'rand'), ('zzz', 'zzz')) v(q, term) ON starts_with(token, term) GROUP BY 1, 2, 3),
df AS (SELECT q, count(*) AS df FROM hit GROUP BY 1), scale AS (SELECT count(*) AS na, avg(length) AS al FROM (SELECT DISTINCT id, length FROM sized)),
ranked AS (SELECT q, id, round(-greatest(ln((na - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al)), 6) AS rank FROM hit JOIN df USING (q), scale),
fell AS (SELECT q, p_partkey AS id, 0.0 AS rank FROM part, (VALUES ('STANDARD'), ('rand#'), ('zzz')) v(q) WHERE q NOT IN (SELECT q FROM ranked) AND (p_name ILIKE '%' || q || '%' OR p_brand || '::' || p_name ILIKE '%' || q || '%'))
SELECT q, id AS symbol_id, p_name AS name, p_brand || '.h' AS path, p_size AS line_number, p_name || '()' AS signature, CAST(rank AS DOUBLE) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, p_name, id) AS k FROM (SELECT * FROM ranked UNION ALL SELECT * FROM fell) JOIN part ON p_partkey = id) WHERE k <= 50""")
def search_both_ways(spark, d):
    """Ranked, and by substring where that finds nothing; with path, line and signature."""
    symbols = _part_symbols(spark, d)
    index = search.build_symbol_index(symbols)
    placed = symbols.drop("signature").join(_read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("line_start"), F.concat("p_name", F.lit("()")).alias("signature")), "id")
    files = _read(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.concat("p_brand", F.lit(".h")).alias("relative_path"))
    return search.search(index, placed, files, ["STANDARD", "rand#", "zzz"]).drop("qualified_name", "kind")


@query("""WITH rows AS (SELECT 0 AS priority, 'symbol' AS source, 'doc' || doc_id AS path, doc_id AS line_number, text FROM documents WHERE source = 'src1'
UNION ALL SELECT 1, 'reference', 'conv' || conv_id, turn, text FROM conversations WHERE conv_id % 20 = 1)
SELECT q, source, path, line_number, CASE WHEN source = 'symbol' THEN substr(text, 1, 200) ELSE text END AS text FROM (
  SELECT q, rows.*, row_number() OVER (PARTITION BY q ORDER BY priority, path, line_number, text) AS k FROM rows, (VALUES ('tion the'), ('NDE'), ('q_e')) v(q) WHERE text ILIKE '%' || q || '%') WHERE k <= 50""")
def search_code(spark, d):
    docs = _read(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.regexp_replace("source", "src", "").cast("long").alias("codebase_id"), F.col("doc_id").alias("line_start"), F.col("text").alias("raw_text"))
    turns = _read(spark, d, "conversations").select(F.concat(F.lit("conv"), "conv_id").alias("path"), (F.col("conv_id") % 20).alias("codebase_id"), F.col("turn").alias("line_number"), F.col("text").alias("context"))
    files = docs.select("path", "codebase_id").unionByName(turns.select("path", "codebase_id")).distinct().select(F.xxhash64("path").alias("file_id"), F.col("path").alias("relative_path"), "codebase_id")
    symbols = docs.select(F.xxhash64("path").alias("file_id"), "line_start", "raw_text")
    return search.search_code(symbols, turns.select(F.xxhash64("path").alias("file_id"), "line_number", "context"), files, ["tion the", "NDE", "q_e"], 1)


#: all runs of three characters: those that follow each other, from the first, the second and the third character
_GRAMS = """grams AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(substr(lower(text), s), '(?s)...')) AS gram FROM documents, (VALUES (1), (2), (3)) v(s))"""


@query(f"WITH {_GRAMS} SELECT gram, count(*) AS n_keys FROM grams GROUP BY 1")
def trigram_index(spark, d):
    """How many documents each gram's posting lists name."""
    index = trigrams.build_trigram_index(_read(spark, d, "documents"), "doc_id")
    return index.groupBy("gram").agg(F.sum(F.size("keys")).cast("long").alias("n_keys"))


@query("""WITH rows AS (SELECT 'doc' || doc_id AS path, doc_id AS line_number, text FROM documents)
SELECT q, path, line_number, substr(text, 1, 200) AS text FROM (
  SELECT q, rows.*, row_number() OVER (PARTITION BY q ORDER BY path, line_number, text) AS k FROM rows, (VALUES ('tion the'), ('NDE'), ('the q_e'), ('e%zz'), ('q_')) v(q) WHERE text ILIKE '%' || q || '%') WHERE k <= 50""")
def search_code_by_trigrams(spark, d):
    """Code search over an index of all documents, as one codebase: patterns with grams, with wildcards, and one that is too short for the index."""
    docs = _read(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("relative_path"), F.lit(1).alias("codebase_id"), F.xxhash64("doc_id").alias("file_id"), F.col("doc_id").alias("line_start"), F.col("text").alias("raw_text"))
    none = spark.createDataFrame([], "file_id long, line_number int, context string")
    index = settled(search.code_trigrams(docs, none, docs), "trigrams")
    return search.search_code(docs, none, docs, ["tion the", "NDE", "the q_e", "e%zz", "q_"], 1, index=index).drop("source")


# scalar functions -----------------------------------------------------------------------------------------------------

_PREFIXED = "n AS (SELECT p_partkey AS k, substr('AUFEITSx', 1 + CAST(p_partkey % 8 AS INTEGER), 1) || CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE upper(p_name) END AS name FROM part)"


@query(f"""WITH {_PREFIXED}, p AS (SELECT *, CASE WHEN regexp_matches(name, '^[AUFEITS][A-Z]') THEN substr(name, 1, 1) ELSE 'None' END AS prefix FROM n)
SELECT k, prefix, CASE prefix WHEN 'A' THEN 'Actor subclass' WHEN 'U' THEN 'UObject subclass' WHEN 'F' THEN 'Struct or plain C++ class' WHEN 'E' THEN 'Enum type' WHEN 'I' THEN 'Interface' WHEN 'T' THEN 'Template type' WHEN 'S' THEN 'Slate widget' ELSE 'No UE prefix' END AS description,
  CASE WHEN prefix = 'None' THEN name ELSE substr(name, 2) END AS stripped, prefix <> 'None' AS is_prefixed FROM p""")
def name_prefixes(spark, d):
    p = _read(spark, d, "part")
    cased = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_name")).otherwise(F.upper("p_name"))
    name = F.concat(F.substring(F.lit("AUFEITSx"), (1 + F.col("p_partkey") % 8).cast("int"), F.lit(1)), cased)
    prefix = functions.name_prefix(name)
    return p.select(F.col("p_partkey").alias("k"), prefix.alias("prefix"), functions.name_prefix_description(prefix).alias("description"), functions.strip_name_prefix(name).alias("stripped"), functions.is_prefixed_type(name).alias("is_prefixed"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'void ' END || 'Run' || p_partkey || '(int32 Size' || CASE WHEN p_partkey % 2 = 0 THEN ' = ' || p_size ELSE '' END || ', ' || p_brand || ' Kind)' || CASE WHEN p_partkey % 3 = 0 THEN ' const' ELSE '' END AS signature,
  'APart' || p_partkey || '::Run' AS qualified, CASE p_partkey % 4 WHEN 0 THEN 'constructor' WHEN 1 THEN 'destructor' WHEN 2 THEN 'method' ELSE 'function' END AS kind,
  CASE WHEN length(p_type) > 12 THEN substr(p_type, 1, 12) || '...' ELSE p_type END AS cut, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '=' || p_type ELSE '' END AS specifier FROM part""")
def signatures(spark, d):
    p = _read(spark, d, "part")
    k = F.col("p_partkey")
    size = F.struct(F.lit("int32").alias("type"), F.lit("Size").alias("name"), F.when(k % 2 == 0, F.col("p_size").cast("string")).alias("default_value"))
    kind = F.struct(F.col("p_brand").alias("type"), F.lit("Kind").alias("name"), F.lit(None).cast("string").alias("default_value"))
    name = F.when(k % 4 == 0, F.lit("APart")).when(k % 4 == 1, F.lit("~APart")).otherwise(F.lit("Run"))
    parent = F.when(k % 4 != 3, F.lit("NS::APart"))
    return p.select(
        k.alias("k"), functions.build_signature(F.when(k % 5 != 0, F.lit("void")), F.concat(F.lit("Run"), k), F.array(size, kind), k % 3 == 0).alias("signature"), functions.qualified_name(F.concat(F.lit("APart"), k), F.lit("Run")).alias("qualified"),
        functions.symbol_kind(name, parent).alias("kind"), functions.truncate_text(F.col("p_type"), 12).alias("cut"), functions.format_specifier(F.col("p_brand"), F.when(k % 2 == 0, F.col("p_type"))).alias("specifier"),
    )


@query("""SELECT file_id, list_last(string_split(relative_path, '/')) AS base, CASE WHEN ends_with(relative_path, '.h') THEN '.h' ELSE '.cpp' END AS ext, relative_path AS slashed, substr(relative_path, length(string_split(relative_path, '/')[1]) + 2) AS inner_path FROM fx_files""")
def path_functions(spark, d):
    f = testdata.files(spark, d)
    back = F.translate("relative_path", "/", "\\")
    return f.select("file_id", functions.basename(back).alias("base"), functions.extension(F.upper(back)).alias("ext"), functions.forward_slashes(back).alias("slashed"), functions.relative_path(back, F.element_at(F.split("relative_path", "/"), 1)).alias("inner_path"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS builtin, p_partkey % 3 = 0 AS exposed,
  CASE p_partkey % 2 WHEN 0 THEN lower(p_brand) || '* x*' ELSE '' END AS cleaned, CASE p_partkey % 6 WHEN 0 THEN 'DECLARE_DYNAMIC_MULTICAST_DELEGATE' WHEN 1 THEN 'DECLARE_DYNAMIC_DELEGATE' WHEN 2 THEN 'DECLARE_MULTICAST_DELEGATE' WHEN 3 THEN 'DECLARE_DELEGATE' WHEN 4 THEN 'DECLARE_EVENT' END AS delegate FROM part""")
def callees_and_keys(spark, d):
    p = _read(spark, d, "part")
    k = F.col("p_partkey")
    name = F.get(F.array(*[F.lit(x) for x in ("UE_LOG", "sizeof", "Tick", "OK", "MAX_VALUE")]), (k % 5).cast("int"))
    keys = F.when(k % 3 == 0, F.array(F.lit("Category"), F.lit("BlueprintPure"))).otherwise(F.array(F.lit("Category"), F.lit("EditAnywhere")))
    text = F.when(k % 2 == 0, F.concat(F.lit('("'), F.lower("p_brand"), F.lit('")  x*'))).otherwise(F.lit(" () "))
    macro = F.get(F.array(*[F.lit(x) for x in ("DECLARE_DYNAMIC_MULTICAST_DELEGATE_OneParam", "DECLARE_DYNAMIC_DELEGATE_RetVal", "DECLARE_MULTICAST_DELEGATE", "DECLARE_DELEGATE_TwoParams", "DECLARE_EVENT", "OTHER")]), (k % 6).cast("int"))
    return p.select(k.alias("k"), functions.is_builtin_callee(name).alias("builtin"), functions.is_blueprint_exposed(keys).alias("exposed"), functions.sanitize_query(text).alias("cleaned"), functions.classify_delegate(macro).alias("delegate"))


@query("SELECT 1 + p_size % 3 AS codebase_id, CASE WHEN max(CASE WHEN p_size % 3 = 1 AND p_partkey % 40 = 3 THEN 1 ELSE 0 END) = 1 THEN 'engine' ELSE 'project' END AS type FROM part GROUP BY 1")
def classify_codebase(spark, d):
    p = _read(spark, d, "part")
    path = F.when((F.col("p_size") % 3 == 1) & (F.col("p_partkey") % 40 == 3), F.concat(F.lit("Engine/Source/Editor/P"), "p_partkey", F.lit(".h"))).otherwise(F.concat(F.lit("Source/P"), "p_partkey", F.lit(".h")))
    return corpus.classify_codebase(p.select((1 + F.col("p_size") % 3).alias("codebase_id"), path.alias("relative_path")))


_TOPS = "['Source/Editor', 'Source/Developer', 'Source/ThirdParty', 'Source', 'Plugins', 'Saved/Source']"


@query(f"""SELECT 1 + p_size % 3 AS codebase_id, 'Mod' || p_partkey AS name, top || '/Mod' || p_partkey AS folder, CASE p_partkey % 6 WHEN 0 THEN 'Editor' WHEN 1 THEN 'Developer' WHEN 2 THEN 'ThirdParty' WHEN 3 THEN 'Runtime' ELSE 'Unknown' END AS type
FROM (SELECT *, {_TOPS}[CAST(p_partkey % 6 AS INTEGER) + 1] AS top FROM part) WHERE p_partkey % 6 <> 5""")
def detect_modules(spark, d):
    p = _read(spark, d, "part")
    top = F.get(F.array(*[F.lit(x) for x in ("Source/Editor", "Source/Developer", "Source/ThirdParty", "Source", "Plugins", "Saved/Source")]), (F.col("p_partkey") % 6).cast("int"))
    path = F.concat(top, F.lit("/Mod"), "p_partkey", F.lit("/Mod"), "p_partkey", F.lit(".Build.cs"))
    return corpus.detect_modules(p.select((1 + F.col("p_size") % 3).alias("codebase_id"), path.alias("relative_path")))
