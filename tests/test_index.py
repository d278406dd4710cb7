import json

import pytest

from tesserae import cli
from tesserae.plans import index as plans
from tesserae.sources import dense
from tesserae.streaming import refresh


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "main.py": "import utils\n\ndef main():\n    helper()\n\ndef helper():\n    return 1\n",
        "utils.py": "def helper(x: int):\n    return deep_helper(x)\n\ndef deep_helper(x):\n    return x\n\nclass Only:\n    pass\n",
        "shape.py": "class Shape:\n    pass\n", "web/app.js": "import x from './lib';\nfunction go() {\n  { run(); }\n}\nfunction run() {}\n", "web/lib.js": "const A = 1;\n",
        "README.md": "# Title\n\nFound in `src/x.py`.\n", "tests/test_a.py": "def test_a():\n    pass\n",
    }
    for p, t in files.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def index(spark, tree):
    return plans.build(spark, str(tree))


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_tables(index):
    assert pairs(index.call_edges) == [("go", "run"), ("helper", "deep_helper"), ("main", "helper")]
    assert pairs(index.xfile_edges.select("src", "dst")) == [("main.py:main", "utils.py:helper")]
    assert pairs(index.dep_edges.select("src", "dst")) == [("main.py", "utils"), ("web/app.js", "web/lib.js")]
    assert pairs(index.docs.select("path", "sections")) == [("README.md", ["Title"])]
    assert [r["hints"] for r in index.docs.collect()] == [["src/x.py"]]
    assert pairs(index.directories.select("path", "purpose")) == [("tests", "Test files and test utilities"), ("web", None)]
    assert plans.stats_of(index) == {"total_files": 6, "total_directories": 2, "markdown_files": 1, "fully_parsed": {"python": 4, "javascript": 2}, "listed_only": {}}


def test_questions(index):
    assert [r[0] for r in index.who_calls("deep_helper", 2).collect()] == ["helper", "main"]
    assert [tuple(r) for r in index.blast_radius("deep_helper").collect()] == [("helper", 1), ("main", 2)]
    assert [r[0] for r in index.dead_code().collect()] == ["main.py:main", "tests/test_a.py:test_a", "web/app.js:go"]
    assert [r["name"] for r in index.search_symbols("HELPER").collect()] == ["helper", "helper", "deep_helper"]
    assert [tuple(r) for r in index.dependency_chain("main.py").collect()] == [("utils", 1)]
    assert index.file_summary("utils.py").first()["classes"] == ["Only"]
    assert index.file_summary("none.py").collect() == []


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "saved"))
    again = plans.CodeIndex.load(spark, str(tmp_path / "saved"))
    assert pairs(again.call_edges) == pairs(index.call_edges)
    again.register("ix_")
    assert spark.sql("select count(*) from ix_symbols").first()[0] == index.symbols.count()


def test_dense_round_trip(spark, index, tree):
    doc = dense.dense(index, str(tree))
    assert doc["f"]["main.py"] == ["p", ["main:3:():helper:", "helper:6:()::"]]
    assert doc["f"]["shape.py"] == ["p", {"Shape": ["1", []]}]
    assert doc["f"]["t/test_a.py"][1] == ["test_a:1:()::"]
    out = dense.export(index, str(tree / cli.NAME), str(tree))
    back = dense.read_json(spark, str(tree / cli.NAME))
    assert [r[0] for r in back.who_calls("deep_helper", 2).collect()] == ["helper", "main"]
    assert {r["name"] for r in back.search_symbols("Shape|Only").collect()} == {"Shape", "Only"}
    assert {r["name"] for r in dense.from_document(spark, out, strict_compat=True).search_symbols("Shape").collect()} == set()
    assert cli.find_index(str(tree / "web")) == tree / cli.NAME


def test_full_form(spark):
    doc = {"files": {"a.py": {"language": "python", "functions": {"f": {"line": 3}, "s": "()"}, "classes": {"C": {"line": 9}}, "imports": ["os"], "purpose": "p", "parsed": True}}, "g": [["f", "s"]], "dependency_graph": {"a.py": ["os"]}}
    ix = dense.from_document(spark, doc)
    assert [tuple(r) for r in ix.search_symbols(".").collect()] == [("a.py", "f", "function", "3"), ("a.py", "s", "function", "0"), ("a.py", "C", "class", "9")]
    assert ix.file_summary("a.py").first()["imports"] == ["os"]
    assert dense.from_document(spark, {}).dead_code().collect() == []


def test_incremental_build_parses_only_what_changed(spark, tree, index):
    first = plans.parsed_rows(plans.file_table(dense_tree(spark, tree)))
    (tree / "shape.py").write_text("class Other:\n    pass\n")
    try:
        again = plans.parsed_rows(plans.file_table(dense_tree(spark, tree)), first)
        names = {r["name"] for r in again.where("kind = 'class'").collect()}
        assert names == {"Only", "Other"}
    finally:
        (tree / "shape.py").write_text("class Shape:\n    pass\n")


def dense_tree(spark, root):
    from tesserae.functions import scalars
    from tesserae.sources import listing
    from pyspark.sql import functions as F

    return listing.read_tree(spark, str(root)).withColumn("content_hash", scalars.content_hash(F.col("content")))


def test_atomic_write(tmp_path):
    path = tmp_path / "x.json"
    dense.write_json(str(path), {"a": [1, 2]})
    assert path.read_text() == '{"a":[1,2]}'
    with pytest.raises(TypeError):
        dense.write_json(str(path), {"a": object()})
    assert json.loads(path.read_text()) == {"a": [1, 2]}
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]


def test_command_line(spark, tree, monkeypatch, capsys, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["dead-code"]) == 1
    monkeypatch.chdir(tree)
    if cli.find_index() is None:
        dense.export(plans.build(spark, "."), cli.NAME)
    capsys.readouterr()
    assert cli.main(["who-calls", "deep_helper", "--depth", "2"]) == 0
    assert json.loads(capsys.readouterr().out) == ["helper", "main"]
    assert cli.main(["blast-radius", "deep_helper"]) == 0
    assert json.loads(capsys.readouterr().out) == {"depth_1": ["helper"], "depth_2": ["main"]}
    assert cli.main(["summary", "nothing.py"]) == 1


def test_stream_of_file_states(spark, tmp_path):
    drop, snapshot = tmp_path / "drop", tmp_path / "snapshot"
    put = lambda rows: spark.createDataFrame(rows, refresh.STATE).coalesce(1).write.mode("append").parquet(str(drop))
    put([("r", "a", 1.0, 1, "h1"), ("r", "b", 1.0, 1, "h2")])
    refresh.follow(refresh.states(spark, str(drop)), str(snapshot), str(tmp_path / "cp")).awaitTermination()
    put([("r", "a", 2.0, 1, "h3"), ("r", "a", 3.0, 1, "h4"), ("r", "c", 1.0, 1, "h5")])
    refresh.follow(refresh.states(spark, str(drop)), str(snapshot), str(tmp_path / "cp")).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in snapshot.iterdir())
    got = {(r["path"], r["content_hash"]) for r in spark.read.parquet(f"{snapshot}/v={last}").collect()}
    assert got == {("a", "h4"), ("b", "h2"), ("c", "h5")}


def test_size_flag():
    assert cli.size_flag("fix it") == (None, None, "fix it")
    assert cli.size_flag("fix it -i") == (50, False, "fix it")
    assert cli.size_flag("-i fix it", 70) == (70, False, "fix it")
    assert cli.size_flag("fix -i250 it") == (100, False, "fix it")
    assert cli.size_flag("fix -ic900 it") == (800, True, "fix it")
    assert cli.size_flag("fix -ic it", 70) == (50, True, "fix it")
    assert cli.size_flag("fix -i0 it")[0] == 1


def test_meta_and_summary(index, tmp_path):
    out = dense.export(index, str(tmp_path / "x.json"), ".", target_k=60)
    assert out["_meta"]["target_size_k"] == 60 == out["_meta"]["last_interactive_size_k"]
    assert len(out["_meta"]["files_hash"]) == 16 and "symbol_importance" in out["_meta"]
    assert "4 python files parsed" in dense.summary(out)
    assert len(dense.summary({"stats": {"total_files": 0}})) == 1


def test_snapshot_that_cannot_be_read(spark, tmp_path):
    from tesserae.operators import incremental

    assert incremental.open_snapshot(spark, str(tmp_path / "none"), "1").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("not parquet")
    assert incremental.open_snapshot(spark, str(tmp_path / "bad"), "1").count() == 0
    row = ("r", "p", 1.0, 1, "h", "python", "{}", "1", 2.0)
    spark.createDataFrame([row], incremental.SNAPSHOT).write.parquet(str(tmp_path / "good"))
    assert incremental.open_snapshot(spark, str(tmp_path / "good"), "1").count() == 1
    assert incremental.open_snapshot(spark, str(tmp_path / "good"), "2").count() == 0
