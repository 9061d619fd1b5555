"""The index over time: versions, detection in two phases, and incremental links against full runs."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from codefacts import changes, corpus, extract, graph, link, reports, search, store, update
from codefacts.tables import SCHEMAS

PATHS = ["A/First.h", "B/Second.h", "B/First.h", "C/Third.cpp", "D/First.h", "Z/Last.cpp"]


def random_source(rng):
    """A class with methods of common names, bases, includes, calls and uses, so that definitions shadow each other between files."""
    name = rng.choice(["AOne", "ATwo", "AThree"])
    methods = rng.sample(["Go", "Stop", "Turn", "Wait"], rng.randrange(1, 4))
    lines = [f'#include "{rng.choice(["First.h", "B/Second.h", "Third.cpp", "D/First.h", "None.h", "st.h"])}"' for _ in range(rng.randrange(3))]
    lines += [f"class {name} : public {rng.choice(['AOne', 'ATwo', 'AFour'])}", "{", "public:"] + [f"    void {m}();" for m in methods] + ["};"]
    for m in methods:
        lines += [f"void {name}::{m}()", "{", *[f"    {rng.choice(['Go', 'Stop', 'Turn', 'Wait', 'Other'])}();" for _ in range(rng.randrange(4))], "}"]
    if rng.random() < 0.4:
        lines += ["void Other()", "{", "    Go();", "}"]
    return "\n".join(lines) + "\n"


def contents(tables):
    """The rows of every table with symbol ids written as (file, name, line) and file ids as paths."""
    path = {r["file_id"]: (r["codebase_id"], r["relative_path"]) for r in tables["files"].collect()}
    place = {r["id"]: (path[r["file_id"]], r["qualified_name"], r["line_start"], r["ord"]) for r in tables["symbols"].collect()}
    out = {}
    for name in ("files", "symbols", "parameters", "inheritance", "calls", "includes", "references_table", "ue_macros", "ue_macro_specifiers"):
        rows = []
        for r in tables[name].collect():
            d = {k: v for k, v in r.asDict().items() if k not in ("codebase_id", "indexed_at", "macro_id") and not (k == "id" and name != "files")}
            for k, v in d.items():
                d[k] = path.get(v, v) if k.endswith("file_id") else place.get(v, ("lost", v) if v is not None else None) if k.endswith("symbol_id") else v
            rows.append(str(sorted(d.items())))
        out[name] = sorted(rows)
    return out


def sources_of(spark, bases):
    rows = [(b, p, t) for b, files in bases.items() for p, t in files.items()]
    return corpus.from_table(spark.createDataFrame(rows, "base long, path string, text string"), "base", "path", "text")


def test_incremental_links_equal_full_runs(spark):
    """Three rounds of random edits to fifty codebases at once: added, changed and deleted files, some of which sort first."""
    rng = random.Random(11)
    bases = {b: {p: random_source(rng) for p in rng.sample(PATHS, 4)} for b in range(50)}
    tables = extract.index_corpus(sources_of(spark, bases))
    for _ in range(3):
        edits, touched = [], {}
        for b, files in bases.items():
            for p in rng.sample(PATHS, rng.randrange(4)):
                if p in files and rng.random() < 0.4:
                    del files[p]
                    edits.append((b, p, "deleted"))
                else:
                    edits.append((b, p, "changed" if p in files else "new"))
                    files[p] = random_source(rng) if rng.random() < 0.8 else "\n" + files.get(p, random_source(rng))
                    touched.setdefault(b, {})[p] = files[p]
        found = spark.createDataFrame(edits, "codebase_id long, relative_path string, status string")
        tables = changes.apply_changes(tables, found, extract.index_corpus(sources_of(spark, touched), linked=False))
        tables = {n: changes.settled(t, n) for n, t in tables.items()}
    got, want = contents(tables), contents(extract.index_corpus(sources_of(spark, bases)))
    for name in want:
        assert got[name] == want[name], name
    links = [r for n in ("calls", "inheritance", "includes", "references_table") for r in want[n]]
    assert len(links) > 1500


@pytest.mark.parametrize("linked", [False, True])
def test_changes_of_symbols_without_kinds(spark, linked):
    """A symbol needs a kind only if calls or classes are linked to it, and a position only if anything is."""
    table = spark.createDataFrame
    files = lambda *rows: table(list(rows), "id long, codebase_id long, relative_path string, content_hash string")
    names = "id long, file_id long, name string" + ", ord int" * linked
    symbols = lambda *rows: table([r[: 3 + linked] for r in rows], names)
    old = {"files": files((1, 1, "a", "h1"), (2, 1, "b", "h2"), (3, 1, "c", "h3")), "symbols": symbols((11, 1, "A", 0), (12, 2, "A", 0), (13, 3, "C", 0))}
    fresh = {"files": files((2, 1, "b", "new"), (4, 1, "d", "h4")), "symbols": symbols((22, 2, "B", 0), (24, 4, "D", 0))}
    if linked:
        old["references_table"] = table([(3, "A", 11), (3, "B", None), (3, "C", 13)], "file_id long, symbol_name string, symbol_id long")
    found = table([(1, "a", "deleted"), (1, "b", "changed"), (1, "c", "unchanged"), (1, "d", "new")], "codebase_id long, relative_path string, status string")
    out = changes.apply_changes(old, found, fresh)
    assert sorted((r["id"], r["content_hash"]) for r in out["files"].collect()) == [(2, "new"), (3, "h3"), (4, "h4")]
    assert sorted((r["id"], r["file_id"], r["name"]) for r in out["symbols"].collect()) == [(13, 3, "C"), (22, 2, "B"), (24, 4, "D")]
    if linked:
        assert sorted((r["symbol_name"], r["symbol_id"] or 0) for r in out["references_table"].collect()) == [("A", 0), ("B", 22), ("C", 13)]


def write_tree(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)


def at(root, path, seconds):
    os.utime(f"{root}/{path}", (seconds, seconds))


def test_the_whole_life_of_an_index(spark, tmp_path):
    """List, detect, extract, write; change; detect, apply, write; read: always the tables of a full run, and no unchanged file is opened."""
    rng = random.Random(5)
    root, folder = str(tmp_path / "tree with space"), str(tmp_path / "index")
    files = {p: random_source(rng) for p in PATHS[:5]}
    write_tree(root, files)
    update.register(spark, folder, spark.createDataFrame([("game", root, "project"), ("other", "/elsewhere", "engine")], "name string, root_path string, type string"))
    base = store.read_index(spark, folder, ["codebases"])["codebases"].filter("name = 'game'").first()
    assert base["last_indexed_at"] is None
    for p in files:
        at(root, p, 1_600_000_000)
    first = update.update_index(spark, folder, base["id"], root).first()
    assert (first["new_files"], first["deleted_files"]) == (5, 0)
    version = store.current_version(spark, folder)
    old = store.read_index(spark, folder, version=version)

    files["B/Second.h"] = random_source(rng) + "// changed\n"
    del files["C/Third.cpp"]
    files["0/Zeroth.h"] = random_source(rng)
    os.remove(f"{root}/C/Third.cpp")
    write_tree(root, {p: files[p] for p in ("B/Second.h", "0/Zeroth.h")})
    at(root, "A/First.h", 1_600_000_500)  # touched, but the same
    write_tree(root, {"D/First.h": "never opened"})  # behind the index's back: the time says unchanged
    at(root, "D/First.h", 1_600_000_000)
    second = update.update_index(spark, folder, base["id"], root).first()
    assert (second["new_files"], second["changed_files"], second["unchanged_files"], second["deleted_files"]) == (1, 1, 3, 1)

    got = store.read_index(spark, folder)
    want = extract.index_corpus(sources_of(spark, {base["id"]: files}))
    narrow = lambda t: {**t, "files": t["files"].select("file_id", "codebase_id", "relative_path", "content_hash")}
    assert contents(narrow(got)) == contents(narrow(want))
    row = got["files"].filter("relative_path = 'B/Second.h'").first()
    assert row["mtime"] and row["file_size"] == len(files["B/Second.h"].encode()) and row["absolute_path"].endswith("B/Second.h")
    # a reader of the version before still has it whole
    assert {r["relative_path"] for r in old["files"].collect()} == set(PATHS[:5]) and old["symbols"].count() > 0
    status = {r["name"]: r for r in reports.index_status(got["codebases"].drop("codebase_id"), got["files"], got["symbols"], got["ue_macros"]).collect()}
    assert status["game"]["n_files"] == 5 and status["game"]["last_indexed_at"] is not None and status["other"]["n_files"] == 0 and status["other"]["last_indexed_at"] is None
    assert store.vacuum(spark, folder, keep=1, older_than_ms=0) > 0
    assert store.read_index(spark, folder)["files"].count() == 5 and store.versions(spark, folder) == [store.current_version(spark, folder)]


def test_unchanged_files_are_not_opened(spark, tmp_path):
    root = str(tmp_path)
    write_tree(root, {"a.h": "1", "b.h": "2", "c.h": "3", "100% x.h": "4"})
    for p in ("a.h", "b.h", "c.h", "100% x.h"):
        at(root, p, 1_600_000_000)
    listing = corpus.discover_files(spark, root).withColumn("codebase_id", F.lit(1).cast("long"))
    known = corpus.read_sources(listing).select("codebase_id", "relative_path", "content_hash", F.when(F.col("relative_path").isin("b.h", "100% x.h"), 0.0).otherwise(F.col("mtime")).alias("mtime"))
    known = changes.settled(known.withColumn("content_hash", F.when(F.col("relative_path") == "b.h", "x").otherwise(F.col("content_hash"))))
    gone = changes.settled(listing)
    os.remove(f"{root}/a.h")  # listed, unchanged by its time: opening it would fail
    got = {r["relative_path"]: r["status"] for r in changes.detect_changes(known, gone).collect()}
    assert got == {"a.h": "unchanged", "b.h": "changed", "c.h": "unchanged", "100% x.h": "unchanged"}
    with pytest.raises(Exception, match="a.h|No such file"):
        corpus.read_sources(gone).collect()


def table_of(spark, rows):
    return spark.createDataFrame(rows, "file_id long, codebase_id long, relative_path string")


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "i")
    one = {"files": table_of(spark, [(1, 1, "a.h"), (2, 1, "b.h")]), "symbols": spark.createDataFrame([(5, 1, "S")], "id long, file_id long, name string")}
    assert store.write_index(one, folder) == 1
    broken = {"files": table_of(spark, [(9, 1, "z.h")]), "symbols": spark.createDataFrame([(5, 9, "S")], "id long, file_id long, name string").withColumn("name", F.raise_error(F.lit("broken")))}
    with pytest.raises(Exception, match="broken"):
        store.write_index(broken, folder)
    back = store.read_index(spark, folder, ["files", "symbols"])
    assert store.current_version(spark, folder) == 1 and back["files"].count() == 2 and back["symbols"].count() == 1
    # in place: read, change, write over what is read
    less = changes.delete_files(back, spark.createDataFrame([(1,)], "id long"))
    assert store.write_index(less, folder, based_on=1) == 2
    now = store.read_index(spark, folder, ["files", "symbols"])
    assert [r["file_id"] for r in now["files"].collect()] == [2] and now["symbols"].count() == 0
    assert back["files"].count() == 2  # still version 1


def test_two_writers(spark, tmp_path):
    """Different codebases both arrive; of two writes to one codebase that rest on the same version the second is refused."""
    folder = str(tmp_path / "i")
    store.write_index({"files": table_of(spark, [(1, 1, "a.h")])}, folder)
    errors = []

    def write(base):
        try:
            store.write_index({"files": table_of(spark, [(base * 10, base, f"{base}.h")])}, folder, based_on=1)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(b,)) for b in (2, 3, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and store.versions(spark, folder) == [1, 2, 3, 4]
    assert {r["codebase_id"] for r in store.read_index(spark, folder, ["files"])["files"].collect()} == {1, 2, 3, 4}
    assert {r["codebase_id"] for r in store.read_index(spark, folder, ["files"], codebase_ids=[2, 3])["files"].collect()} == {2, 3}
    with pytest.raises(store.Conflict):
        store.write_index({"files": table_of(spark, [(11, 2, "x.h")])}, folder, based_on=1)
    assert store.current_version(spark, folder) == 4
    assert set(store.read_index(spark, folder)) == set(SCHEMAS)


def test_registering_keeps_the_time_of_the_last_run(spark):
    known = spark.createDataFrame([(1, "a", "/a", "project", 5, 7)], "id long, name string, root_path string, type string, c long, l long")
    known = known.select("id", "name", "root_path", "type", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("l").alias("last_indexed_at"))
    more = known.drop("last_indexed_at").withColumn("name", F.lit("b")).withColumn("created_at", F.timestamp_seconds(F.lit(99)))
    got = corpus.register_codebases(known, more).select("id", "name", F.unix_seconds("created_at"), F.unix_seconds("last_indexed_at")).collect()
    assert [tuple(r) for r in got] == [(1, "b", 5, 7)]
    assert [r["last_indexed_at"] is None for r in corpus.register_codebases(known.limit(0), more).collect()] == [True]


def test_equal_items_stay_and_many_functions_in_one_file(spark):
    symbols = spark.createDataFrame([(1, 10, "f", "f", "function", 0, 1, 300), (1, 11, "g", "g", "method", 1, 5, 6), (2, 12, "h", "h", "field", 0, 1, 9)], "file_id long, id long, name string, qualified_name string, kind string, ord int, line_start int, line_end int")
    items = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 200, "y"), (1, 301, "z"), (2, 3, "w"), (1, 5, None)], "file_id long, line_number int, callee_name string")
    got = sorted((r["line_number"], str(r["callee_name"]), r["caller_symbol_id"]) for r in link.attach_enclosing_function(items, symbols).collect())
    assert got == [(5, "None", 10), (5, "x", 10), (5, "x", 10), (200, "y", 10)]
    n = 20_000
    many = spark.range(n).select(F.lit(1).cast("long").alias("file_id"), "id", F.lit("f").alias("name"), F.lit("f").alias("qualified_name"), F.lit("function").alias("kind"), F.col("id").cast("int").alias("ord"), (F.col("id") * 4).cast("int").alias("line_start"), (F.col("id") * 4 + 2).cast("int").alias("line_end"))
    calls = spark.range(5 * n).select(F.lit(1).cast("long").alias("file_id"), (F.col("id") % (4 * n)).cast("int").alias("line_number"))
    out = link.attach_enclosing_function(calls, many)
    assert out.filter("caller_symbol_id <> line_number div 4").count() == 0 and out.count() == sum(i % (4 * n) % 4 < 3 for i in range(5 * n))


def specifiers_of(spark, text):
    source = corpus.from_table(spark.createDataFrame([("a.h", text)], "path string, text string"), 1, "path", "text")
    found = extract.extract_macros(source)
    keys = extract.explode_specifiers(found).join(found.select(F.col("id").alias("macro_id"), "line_number"), "macro_id").orderBy("line_number", "ord")
    return [(r["macro_type"], r["line_number"], r["raw_text"]) for r in found.orderBy("line_number").collect()], [(r["line_number"], r["key"], r["value"], r["is_meta"]) for r in keys.collect()]


def test_comments_in_macros_are_no_specifiers(spark):
    text = 'UPROPERTY(EditAnywhere, // why, )\n    BlueprintReadWrite, /* a, b) */ Category="x // no, comment")\nint32 A;\nUFUNCTION(BlueprintCallable) // later, )\nvoid F();\n'
    found, keys = specifiers_of(spark, text)
    assert [f[:2] for f in found] == [("UPROPERTY", 1), ("UFUNCTION", 4)]
    assert keys == [(1, "EditAnywhere", None, False), (1, "BlueprintReadWrite", None, False), (1, "Category", "x // no, comment", False), (4, "BlueprintCallable", None, False)]


@pytest.mark.parametrize("depth", [1, 6, 7, 40])
def test_brackets_of_any_depth(spark, depth):
    deep = "(" * depth + "a, b" + ")" * depth
    text = f"UPROPERTY(meta=(A={deep}, B), Category=[x, {{y, TMap<K, V>}}])\nint32 A;\nUPROPERTY(EditAnywhere)\nint32 B;\nUFUNCTION(\n"
    found, keys = specifiers_of(spark, text)
    assert [f[:2] for f in found] == [("UPROPERTY", 1), ("UPROPERTY", 3), ("UFUNCTION", 5)] and found[0][2] == text.split("\n")[0]
    assert [(k[1], k[3]) for k in keys] == [("A", True), ("B", True), ("Category", False), ("EditAnywhere", False)] and keys[2][2] == "[x, {y, TMap<K, V>}]"


def test_folding_of_several_alphabets(spark):
    pairs = {"Žluťoučký": "zlutoucky", "ŁÓDŹ": "lodz", "Ångström": "angstrom", "cafés": "cafes", "ΆΝΘΡΩΠΟΣ ΐ": "ανθρωπος ι", "Ёлка Йод": "елка иод", "İstanbul ığ": "istanbul ig", "Việt Nam": "viet nam", "Ørsted": "orsted", "ß æ": "ß æ"}
    got = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for t in pairs], "t string").select("t", search.fold(F.col("t")).alias("f")).collect()}
    assert {t: f.replace("ς", "σ") for t, f in got.items()} == {t: f.replace("ς", "σ") for t, f in pairs.items()}


def test_lines_that_no_symbol_or_reference_holds(spark):
    files = spark.createDataFrame([(1, 1, "a.h"), (2, 2, "b.h")], "file_id long, codebase_id long, relative_path string")
    symbols = spark.createDataFrame([(1, 1, "void Needle();")], "file_id long, line_start int, raw_text string")
    references = spark.createDataFrame([], "file_id long, line_number int, context string")
    sources = spark.createDataFrame([(1, "void Needle();\n// a needle\r\nx"), (2, "needle")], "file_id long, content string")
    rows = lambda **kw: [tuple(r)[1:] for r in search.search_code(symbols, references, files, "needle", 1, **kw).collect()]
    assert rows() == [("symbol", "a.h", 1, "void Needle();")]
    assert sorted(rows(sources=sources)) == [("line", "a.h", 1, "void Needle();"), ("line", "a.h", 2, "// a needle"), ("symbol", "a.h", 1, "void Needle();")]


def test_lookups_filter_calls_where_they_are_read(spark, tmp_path):
    """No exchange moves all calls: below every one of them stands the join with the names or ids asked for."""
    rows = [(i, 1, i % 7, f"A::F{i % 7}", i % 5, f"F{i % 5}", i) for i in range(200)]
    spark.createDataFrame(rows, "id long, file_id long, caller_symbol_id long, caller_name string, callee_symbol_id long, callee_name string, line_number int").write.parquet(f"{tmp_path}/calls")
    spark.createDataFrame([(i, f"F{i}") for i in range(7)], "id long, name string").write.parquet(f"{tmp_path}/symbols")
    calls, symbols = spark.read.parquet(f"{tmp_path}/calls"), spark.read.parquet(f"{tmp_path}/symbols")
    files = spark.createDataFrame([(1, "a.cpp")], "file_id long, relative_path string")
    for find, name in ((graph.find_callers, "callee_name"), (graph.find_callees, "caller_name")):
        out = find(calls, symbols, files, ["F3"], limit=None)
        assert out.count() == sum(r[4 if name == "callee_name" else 2] == 3 for r in rows)
        lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        for i, line in enumerate(lines):
            if "Relation" in line and "caller_name" in line:
                above = [x for x in lines[:i] if "Join" in x and x.index("Join") < line.index("Relation")]
                assert any(f"{name}#" in above[-1] or "symbol_id#" in above[-1] for _ in [0]), above


def test_includes_of_one_basename(spark):
    """Whole and partial ends of paths, by the first path; against a plain loop."""
    rng = random.Random(2)
    paths = sorted({"/".join([*(rng.choice(["A", "BA", "Public", "NotPublic", "x"]) for _ in range(rng.randrange(4))), "Types.h"]) for _ in range(60)})
    wanted = ["Types.h", "Public/Types.h", "ublic/Types.h", "A/Types.h", "x/A/Types.h", "none/Types.h", "A/A/A/A/A/Types.h", "pes.h", "/Types.h"]
    files = spark.createDataFrame([(i, 1, p) for i, p in enumerate(paths)], "file_id long, codebase_id long, relative_path string")
    includes = spark.createDataFrame([(0, i, w, False, None) for i, w in enumerate(wanted)], "file_id long, line_number int, included_path string, is_system boolean, resolved_file_id long")
    got = {r["included_path"]: r["resolved_file_id"] for r in link.resolve_includes(includes, files).collect()}
    for w in wanted:
        same = [p for p in paths if p.split("/")[-1] == w.split("/")[-1]]
        want = w if w in paths else same[0] if len(same) == 1 else next((p for p in same if p.endswith(w)), None)
        assert got[w] == (paths.index(want) if want else None), w
