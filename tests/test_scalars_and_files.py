import fnmatch
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import budget, incremental, stats
from tesserae.sources import listing


def each(spark, f, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


def test_paths(spark):
    assert each(spark, S.extension, "a/b.py", "a.tar.gz", ".bashrc", "a/.env.sh", "none") == [".py", ".gz", "", ".sh", ""]
    assert each(spark, S.stem, "a/b.py", "a.tar.gz", ".bashrc") == ["b", "a.tar", ".bashrc"]
    assert each(spark, S.directory, "a/b/c.py", "c.py") == ["a/b", "."]
    assert each(spark, S.abbreviate_path, "scripts/x.py", "src/tests/x", "lib/scripts/src/y") == ["s/x.py", "sr/t/x", "lib/s/sr/y"]


def test_languages_and_purposes(spark):
    assert each(spark, S.language_name, ".py", ".tsx", ".go", "", None) == ["python", "typescript", "go", "unknown", "unknown"]
    assert each(spark, S.language_letter, "python", "json", "go", None) == ["p", "n", "u", "u"]
    assert each(spark, S.file_purpose, "x/Main.py", "test_a.py", "my_settings.py", "router.js", "models.py", "helper.sh", "middleware.js", "other.py") == [
        "Application entry point", "Test file", "Configuration", "Route definitions", "Data model", "Utility functions", "Middleware", None,
    ]
    inside = lambda c: S.directory_purpose(c, F.array(F.lit("user_model.py")))
    assert each(spark, inside, "x/auth", "x/my_models_dir", "misc") == ["Authentication and authorization logic", "Data models and database schemas", "Data models and schemas"]


def test_text_functions(spark):
    assert each(spark, S.constant_type, "{1}", "[1]", "'a'", '"b"', "`c`", "-1.5", "1.2.3", "x", "") == ["collection", "collection", "str", "str", "str", "number", "number", "value", "value"]
    assert each(spark, S.truncate_doc, " a\nb ", "x" * 80, "x" * 81, None) == ["a b", "x" * 80, "x" * 77 + "...", ""]
    dense = each(spark, lambda c: S.dense_function(F.lit("f"), F.lit(3), c, F.array(F.lit("a"), F.lit("b")), F.lit("doc")), "(x: int) -> str")
    assert dense == ["f:3:(x:int)>str:a,b:doc"]
    assert each(spark, S.dense_line, "f:3:()::", "f") == ["3", "0"]
    assert each(spark, S.sections, "# A\n#### no\n## B c\n### D") == [["A", "B c", "D"]]
    assert each(spark, S.hints, "Found in `src/app.py`; see docs/a.md for more, see http/x for it. file lib/b.py, lib/b.py contains it") == [["docs/a.md", "lib/b.py", "src/app.py"]]
    body = "foo(1); bar (2); self.baz(3); print(foo(4))"
    known = lambda c: S.known_calls(c, F.array(*[F.lit(x) for x in ("foo", "baz", "print", "qux")]), ("print",))
    assert each(spark, known, body) == [["baz", "foo"]]


@pytest.mark.parametrize("glob", ["*.py", "build", "a?c.txt", "[ab]*.js", "[!a]x", "src/*/gen", "**/x.py", "we.ird+(name)"])
def test_globs_match_like_the_shell(glob):
    names = ["a.py", "x/a.py", "build", "abc.txt", "a.js", "bx.js", "cx", "ax", "src/q/gen", "src/a/b/gen", "k/x.py", "we.ird+(name)", "weXird", "", "a\nb.py"]
    java = listing.java_regex(glob).replace("(?s)^", "").rstrip("$")
    for n in names:
        assert bool(re.fullmatch(java, n, re.DOTALL)) == fnmatch.fnmatchcase(n, glob), n


def test_ignored_files(spark):
    paths = ["app.py", "node_modules/p/i.js", "x/build/a.py", "a.pyc", "docs/a.md", "logs/x.py", "keep.log"]
    df = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, ord int")
    assert [r["path"] for r in listing.indexable(df, ["logs/", "!logs/x.py", "# c", ""]).orderBy("ord").collect()] == ["app.py", "docs/a.md"]
    assert [r["path"] for r in listing.not_ignored(df, ["*.py*"]).orderBy("ord").collect()] == ["node_modules/p/i.js", "docs/a.md", "keep.log"]


def test_first_files_keeps_documents(spark):
    df = spark.createDataFrame([("a", 0, False), ("b", 1, True), ("c", 2, False), ("d", 3, False)], "path string, ord int, markdown boolean")
    assert sorted(r["path"] for r in listing.first_files(df, 2).collect()) == ["a", "b", "c"]


def test_read_tree(spark, tmp_path):
    for p, t in {"main.py": "x = 1\n", "src/utils.py": "def f(): pass\n", "node_modules/i.js": "", "notes.txt": "", "a b.md": "# T\n", "skip/x.py": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / ".gitignore").write_text("skip/\n")
    assert [r["path"] for r in listing.read_tree(spark, str(tmp_path)).orderBy("ord").collect()] == ["a b.md", "main.py", "src/utils.py"]
    (tmp_path / "b[1]{x}.py").write_text("y = 2\n")
    first = listing.read_tree(spark, str(tmp_path), 1).orderBy("ord").collect()
    assert [(r["path"], bytes(r["content"])) for r in first] == [("a b.md", b"# T\n"), ("b[1]{x}.py", b"y = 2\n")]
    (tmp_path / "b[1]{x}.py").unlink()
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert sorted(listing.git_files(str(tmp_path))) == [".gitignore", "a b.md", "main.py", "node_modules/i.js", "notes.txt", "src/utils.py"]
    assert listing.project_root(str(tmp_path / "src")) == tmp_path.resolve()


STATE = "root string, path string, mtime double, size long, content_hash string"


def test_dirty_files(spark):
    now = [("r", "new", 1.0, 1, "a"), ("r", "same", 1.0, 1, "x"), ("r", "touched", 2.0, 1, "b"), ("r", "edited", 2.0, 2, "c"), ("r", "old", 1.0, 1, "d"), ("s", "same", 9.0, 1, "z")]
    then = [("r", "same", 1.0, 1, "y", "1"), ("r", "touched", 1.0, 1, "b", "1"), ("r", "edited", 1.0, 1, "q", "1"), ("r", "old", 1.0, 1, "d", "0"), ("r", "gone", 1.0, 1, "e", "1")]
    current, cached = spark.createDataFrame(now, STATE), spark.createDataFrame(then, STATE + ", tool_version string")
    status = incremental.dirty_files(current, cached, "1")
    got = {(r["root"], r["path"]): (r["dirty"], r["refresh"]) for r in status.collect()}
    assert got == {("r", "new"): (True, False), ("r", "same"): (False, False), ("r", "touched"): (False, True), ("r", "edited"): (True, False), ("r", "old"): (True, False), ("s", "same"): (True, False)}
    assert tuple(incremental.dirty_fraction(status).first()) == (6, 4, True)
    assert [r["path"] for r in incremental.removed_files(cached, current).collect()] == ["gone"]
    assert sorted((r["root"], r["path"]) for r in incremental.purge(cached, current).collect()) == [("r", "edited"), ("r", "old"), ("r", "same"), ("r", "touched")]
    assert incremental.upsert(cached, current.withColumn("tool_version", F.lit("1"))).count() == 7


def test_half_dirty_is_no_rebuild(spark):
    half = spark.createDataFrame([(True,), (False,)], "dirty boolean")
    assert incremental.dirty_fraction(half).first()["rebuild"] is False
    assert incremental.dirty_fraction(half.limit(0)).first()["rebuild"] is False


def test_staleness():
    assert incremental.is_stale(None, "h")
    assert incremental.is_stale("a", "b")
    assert not incremental.is_stale("a", "unknown")
    assert not incremental.is_stale("a", "a", 50, 48)
    assert incremental.is_stale("a", "a", 50, 47)
    assert incremental.is_stale_at_stop("a", "unknown")
    assert not incremental.is_stale_at_stop("a", "a")


def big_index():
    files = {f"src/m{i}.py": ["p", [f"f{j}:{j}:(a:int)>str:x,y:{'some documentation ' * 4}" for j in range(20)], *([{"C": ["3", []]}] if i % 9 == 0 else [])] for i in range(200)}
    return {"at": "", "root": ".", "tree": [f"line {k}" for k in range(50)], "f": files, "g": [[f"a{k}", f"b{k}"] for k in range(100)], "d": {f"d{k}.md": [f"s{j}" for j in range(10)] for k in range(20)}, "deps": {}}


@pytest.mark.parametrize("share", [0.99, 0.7, 0.5, 0.25, 0.1])
def test_budget(share):
    index = big_index()
    size = budget.size_of(index)
    out = budget.fit(index, int(size * share))
    assert budget.size_of(out) <= int(size * share)
    assert budget.size_of(index) == size
    assert budget.fit(index, size) is index
    kept = list(out["f"])
    if len(kept) < 200:
        assert {p for p in index["f"] if len(index["f"][p]) > 2} & set(kept) == set(kept[: len(kept)]) & {p for p in index["f"] if len(index["f"][p]) > 2}


def test_top_files(spark):
    rows = [(f"p{k}", k % 7, k, 100) for k in range(100)]
    files = spark.createDataFrame(rows, "path string, importance int, ord int, size int")
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    for target, keep in ((10_000, 100), (5_000, 45), (100, 10)):
        assert sorted(r["path"] for r in budget.top_files(files, target).collect()) == sorted(want[:keep])


def test_directory_counts(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("z.py",)], "path string")
    assert sorted(map(tuple, stats.directory_counts(files).collect())) == [("a", 2), ("a/b", 1)]
