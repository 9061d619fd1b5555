"""Tables are broadcast by their measured size: files hold far fewer bytes than their rows take in memory."""

import os

import pytest

from codefacts import catalog, graph
from codefacts.tables import join_by_measured_sizes, names_table

SF = "/root/testdata/sf0.01"
LIMIT = "spark.sql.autoBroadcastJoinThreshold"
#: Bytes that Spark's row of two columns has at least.
ROW = 24


def _broadcasts(spark, first):
    """Rows of each table that executions from number first on have broadcast."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for id_ in (runs.apply(i).executionId() for i in range(runs.size())):
        if id_ < first:
            continue
        nodes, values = store.planGraph(id_).allNodes(), store.executionMetrics(id_)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                kinds = node.metrics()
                for m in (kinds.apply(i) for i in range(kinds.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def _next(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return 1 + max([-1, *(runs.apply(i).executionId() for i in range(runs.size()))])


@pytest.fixture
def limit(spark):
    """A limit of 50 KB, as small beside sf0.01 as 10 MB beside 60 times sf0.1."""
    join_by_measured_sizes(spark, False)
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "50000")
    yield 50_000
    join_by_measured_sizes(spark, False)
    spark.conf.set(LIMIT, before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["class_children", "class_descendants", "class_hierarchy", "find_callers", "find_references", "index_corpus"])
def test_no_large_table_is_broadcast(spark, limit, name):
    first = _next(spark)
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert max(_broadcasts(spark, first), default=0) * ROW <= limit


def test_listed_names_are_broadcast_and_the_own_plan_comes_back(spark, limit):
    join_by_measured_sizes(spark)
    assert spark.conf.get(LIMIT) == "-1" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "50000"
    join_by_measured_sizes(spark)
    first = _next(spark)
    symbols = spark.range(1000).selectExpr("id", "concat('F', id) AS name", "id AS file_id")
    calls = spark.range(1000).selectExpr("id", "concat('F', id % 9) AS callee_name", "id AS callee_symbol_id")
    assert graph.named(calls, symbols, ["F3", "F4"], "callee_name", "callee_symbol_id").count() == 222
    assert names_table(spark, ["a", "a", "b"]).count() == 2
    assert _broadcasts(spark, first)
    join_by_measured_sizes(spark, False)
    assert spark.conf.get(LIMIT) == "50000"


def test_calls_of_a_table_of_names_are_read_once(spark, tmp_path):
    """Names in a DataFrame give the rows that a list of them gives, stored and resolved names alike, from one reading of the calls."""
    rows = [(i, 1, i % 7 if i % 3 else None, f"A::F{i % 7}" if i % 4 else f"F{i % 7}", i % 5 if i % 2 else None, f"F{i % 6}", i) for i in range(200)]
    spark.createDataFrame(rows, "id long, file_id long, caller_symbol_id long, caller_name string, callee_symbol_id long, callee_name string, line_number int").write.parquet(f"{tmp_path}/calls")
    calls = spark.read.parquet(f"{tmp_path}/calls")
    symbols = spark.createDataFrame([(i, f"F{i}") for i in range(7)], "id long, name string")
    files = spark.createDataFrame([(1, "a.cpp")], "file_id long, relative_path string")
    names = ["F3", "A::F3", "F5", "F0", "none"]
    for find in (graph.find_callers, graph.find_callees):
        for limit in (None, 4):
            out = find(calls, symbols, files, spark.createDataFrame([(n,) for n in [*names, "F3"]], "n string"), limit)
            assert sorted(out.collect()) == sorted(find(calls, symbols, files, names, limit).collect())
            lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
            assert sum("Relation" in x and "caller_name" in x for x in lines) == 1
