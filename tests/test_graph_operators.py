import pytest
from pyspark.sql import functions as F

from tesserae.operators import graphs, rank, traverse


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def reference_rank(pairs, iterations=20, d=0.85, tolerance=1e-6):
    pairs = sorted(set(pairs))
    nodes = sorted({x for p in pairs for x in p})
    out = {x: sum(a == x for a, _ in pairs) for x in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes)) if nodes else {}
    for _ in range(iterations if nodes else 0):
        lost = sum(r[x] for x in nodes if not out[x])
        new = {x: (1 - d) / len(nodes) + d * (sum(r[a] / out[a] for a, b in pairs if b == x) + lost / len(nodes)) for x in nodes}
        change = max(abs(new[x] - r[x]) for x in nodes)
        r = new
        if change < tolerance:
            break
    top = max(r.values(), default=1)
    return {x: v / top for x, v in r.items()}


CHAIN = [("A", "B"), ("B", "C")]
HUB = [("A", "B"), ("A", "C"), ("A", "D")]
NORM = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")]
RING = [(f"n{i}", f"n{(i + 1) % 10}") for i in range(10)] + [("n0", "n5"), ("n3", "n7")]


@pytest.mark.parametrize("pairs", [[], CHAIN, HUB, [("A", "B"), ("B", "A")], NORM, [("a", "a")], [("A", "B"), ("A", "B")], RING], ids=["none", "chain", "hub", "cycle", "norm", "self", "twice", "ring"])
def test_pagerank(spark, pairs):
    got = {r["symbol"]: r["score"] for r in rank.pagerank(edges(spark, *pairs)).collect()}
    want = reference_rank(pairs)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pagerank_values(spark):
    got = {r["symbol"]: r["score"] for r in rank.pagerank(edges(spark, *CHAIN)).collect()}
    assert got == pytest.approx({"A": 0.3887263170, "B": 0.7191439350, "C": 1.0}, abs=1e-9)


def test_top_symbols_break_ties_by_name(spark):
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.123456)], "symbol string, score double")
    assert [tuple(r) for r in rank.top_symbols(scores, 2).collect()] == [("a", 1.0), ("b", 1.0)]


CALLS = [("main", "helper"), ("main", "process"), ("helper", "deep_helper")]
ACROSS = [("main.py:main", "utils.py:helper")]


def test_who_calls(spark):
    e = edges(spark, *CALLS, *ACROSS)
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(traverse.who_calls(e, "helper")) == ["main"]
    assert names(traverse.who_calls(e, "deep_helper", 2)) == ["helper", "main"]
    assert names(traverse.who_calls(e, "utils.py:helper")) == ["main.py:main"]
    assert names(traverse.who_calls(e, "nobody", 3)) == []
    assert names(traverse.who_calls(e, "helper", 0)) == []


def test_a_seed_on_a_cycle_calls_itself_but_is_not_in_its_blast_radius(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert sorted(r[0] for r in traverse.who_calls(e, "a", 2).collect()) == ["b", "c"]
    assert sorted(r[0] for r in traverse.who_calls(e, "a", 3).collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, traverse.blast_radius(e, "a", 5).collect())) == [("b", 2), ("c", 1)]
    assert [tuple(r) for r in traverse.who_calls(edges(spark, ("x", "x")), "x", 1).collect()] == [("x",)]


def test_blast_radius_and_chain(spark):
    assert sorted(map(tuple, traverse.blast_radius(edges(spark, *CALLS), "deep_helper").collect())) == [("helper", 1), ("main", 2)]
    assert [tuple(r) for r in traverse.dependency_chain(edges(spark, ("main.py", "utils")), "main.py").collect()] == [("utils", 1)]
    assert traverse.blast_radius(edges(spark), "x").collect() == []


SYMBOLS = "path string, kind string, owner string, name string, line int, ord int, file_ord int, calls array<string>"
FIXTURE = [
    ("main.py", "function", None, "main", 1, 0, 0, ["helper", "process"]), ("main.py", "function", None, "unused_func", 10, 1, 0, []),
    ("utils.py", "function", None, "helper", 1, 0, 1, ["deep_helper"]), ("utils.py", "function", None, "process", 5, 1, 1, []), ("utils.py", "function", None, "deep_helper", 10, 2, 1, []),
]


def test_dead_symbols_and_search(spark):
    s = spark.createDataFrame(FIXTURE, SYMBOLS)
    dead = graphs.dead_symbols(s, edges(spark, *CALLS), edges(spark, *ACROSS))
    assert sorted(r[0] for r in dead.collect()) == ["main.py:main", "main.py:unused_func"]
    assert [(r["name"], r["line"]) for r in graphs.search(s, "help").collect()] == [("helper", "1"), ("deep_helper", "10")]
    assert [r["name"] for r in graphs.search(s, "^MAIN$").collect()] == ["main"]
    assert graphs.search(s, "(").collect() == []
    for pattern in (r"(?P<n>h)elp", r"(?P<n_1>h)elp", r"(h)?(?(1)elp|zzz)", r"(?P<x>e)l(?:p)(?P=x)"):  # Java's engine takes the first and the last, rewritten
        assert [r["name"] for r in graphs.search(s, pattern).collect()] == ["helper", "deep_helper"], pattern


def test_file_summary(spark):
    files = spark.createDataFrame([("main.py", "python", None, True), ("bare.py", None, None, None)], "path string, language string, purpose string, parsed boolean")
    imports = spark.createDataFrame([("main.py", 0, "utils")], "path string, ord int, module string")
    got = {r["path"]: r for r in graphs.file_summaries(files, spark.createDataFrame(FIXTURE, SYMBOLS), imports).collect()}
    assert got["main.py"].asDict() == {"path": "main.py", "language": "python", "functions": ["main", "unused_func"], "classes": [], "imports": ["utils"], "purpose": "", "parsed": True}
    assert (got["bare.py"]["language"], got["bare.py"]["functions"], got["bare.py"]["parsed"]) == ("unknown", [], False)


def test_callers_reach_methods_by_both_names(spark):
    rows = [("a.py", "method", "App", "run", 1, 0, 0, ["go"]), ("b.py", "function", None, "go", 1, 0, 1, []), ("b.py", "method", "Car", "go", 2, 1, 1, [])]
    s = spark.createDataFrame(rows, SYMBOLS)
    e = graphs.edge_union(graphs.call_edges(s.withColumn("called_by", F.array().cast("array<string>"))), edges(spark, ("x", "Car.go")))
    got = {(r["owner"], r["name"]): r["called_by"] for r in graphs.with_callers(s, e).collect()}
    assert got == {("App", "run"): [], (None, "go"): ["App.run"], ("Car", "go"): ["App.run", "x"]}


def test_module_map(spark):
    files = spark.createDataFrame([("pkg/__init__.py",), ("pkg/utils.py",), ("main.py",), ("a/b/c.py",), ("readme.txt",)], "path string")
    got = {r["module"]: r["path"] for r in graphs.module_map(files).collect()}
    assert got == {"pkg": "pkg/__init__.py", "pkg.__init__": "pkg/__init__.py", "pkg.utils": "pkg/utils.py", "main": "main.py", "a.b.c": "a/b/c.py"}


def xfile(spark, symbols, imports):
    s = spark.createDataFrame([(p, k, o, n, 1, 0, 0, c) for p, k, o, n, c in symbols], SYMBOLS)
    files = s.select("path").distinct()
    i = spark.createDataFrame(imports, "path string, module string")
    return sorted(map(tuple, graphs.xfile_edges(s, graphs.import_targets(i, graphs.module_map(files), files)).collect()))


def test_cross_file_edges(spark):
    helper = ("utils.py", "function", None, "helper", [])
    assert xfile(spark, [("main.py", "function", None, "run", ["helper"]), helper], [("main.py", "utils")]) == [("main.py:run", "utils.py:helper", "call")]
    assert xfile(spark, [("main.py", "function", None, "run", ["helper"]), helper], [("main.py", "os")]) == []
    assert xfile(spark, [("app.py", "method", "App", "start", ["connect"]), ("db.py", "method", "Db", "connect", [])], [("app.py", "db")]) == [("app.py:App.start", "db.py:connect", "call")]
    assert xfile(spark, [("mod.py", "function", None, "f", ["f"])], [("mod.py", "mod")]) == []


def test_relative_imports_take_the_first_suffix(spark):
    files = spark.createDataFrame([("a/b.py",), ("a/b.js",), ("c/d.ts",), ("x.js",), ("a/e/f.js",)], "path string")
    imports = [("a/m.py", 0, "./b"), ("a/e/m.js", 1, "../../c/d"), ("a/m.js", 2, "../x"), ("m.js", 3, "./x"), ("a/m.py", 4, "os"), ("a/m.py", 5, "./none"), ("a/m.js", 6, "./e/f")]
    got = sorted(map(tuple, graphs.resolve_imports(spark.createDataFrame(imports, "path string, ord int, module string"), files).select("ord", "dst").collect()))
    assert got == [(0, "a/b.py"), (1, "c/d.ts"), (2, "x.js"), (3, "x.js"), (4, "os"), (6, "a/e/f.js")]
