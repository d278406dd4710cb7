"""Which files of a tree are indexed: by extension, ignored directories and ignore patterns, all as expressions."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import fixed, scalars


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: no blanks, comments or negations."""
    lines = (line.strip() for line in text.splitlines())
    return [x for x in lines if x and x[0] not in "#!"]


def java_regex(glob: str) -> str:
    """The anchored pattern of a shell glob, in which ``*`` crosses slashes too."""
    out, k = "", 0
    while k < len(glob):
        c, k = glob[k], k + 1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            inside, k = glob[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&"), end + 1
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]"
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def any_like(texts: Column, regex: str) -> Column:
    return F.exists(texts, lambda t: t.rlike(regex))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches: a part of the path, or, as it has a slash or not, the whole path or the name."""
    parts = F.split(path, "/")
    hit = F.lit(False)
    for p in ignore_patterns("\n".join(patterns)):
        hit = hit | any_like(parts, java_regex(p.rstrip("/")))
        whole = [p, *([p[1:]] if p.startswith("/") else [])] if "/" in p else [p, f"**/{p}"]
        for w in whole:
            hit = hit | path.rlike(java_regex(w))
    return hit


def not_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(~ignored(F.col("path"), patterns))


def indexable(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Code and documents outside ignored directories. Paths are relative, so that a tree's own place doesn't hide it."""
    ext = scalars.extension(F.col("path"))
    kept = files.where(ext.isin(*fixed.CODE_EXTENSIONS, *fixed.MARKDOWN_EXTENSIONS))
    kept = kept.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in fixed.IGNORE_DIRS])))
    return not_ignored(kept, patterns) if patterns else kept


def first_files(files: DataFrame, most: int = fixed.MAX_FILES) -> DataFrame:
    """The first code files in order; documents don't count and stay."""
    markdown = F.coalesce(F.col("markdown"), F.lit(False)) if "markdown" in files.columns else F.lit(False)
    code = files.where(~markdown).orderBy("ord").limit(most)
    return code.unionByName(files.where(markdown))


def git_files(root: str) -> list[str] | None:
    """Tracked and unignored paths, or None where git can't tell."""
    try:
        done = subprocess.run(["git", "ls-files", "--cached", "--others", "--exclude-standard"], cwd=root, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    if done.returncode:
        return None
    return [p for p in done.stdout.splitlines() if (Path(root) / p).is_file()]


def changed_paths(root: str) -> set[str]:
    """Paths that differ from the last commit, staged ones among them."""
    out: set[str] = set()
    for more in (["HEAD"], ["--cached"]):
        try:
            done = subprocess.run(["git", "diff", "--name-only", *more], cwd=root, capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            continue
        if not done.returncode:
            out |= {p for p in done.stdout.splitlines() if p}
    return out


def project_root(start: str = ".") -> Path:
    """The nearest of: a git directory here, a project file here, a git directory above; else here."""
    here = Path(start).resolve()
    if (here / ".git").exists() or any((here / m).exists() for m in ("package.json", "pyproject.toml", "setup.py", "Cargo.toml", "go.mod")):
        return here
    return next((p for p in here.parents if (p / ".git").exists()), here)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, mtime, size, ord, uri`` of the indexable files below a local or remote root, without their contents."""
    where = Path(root)
    ignore = where / ".gitignore"
    patterns = [*fixed.IGNORE_DIRS, *(ignore_patterns(ignore.read_text(errors="ignore")) if ignore.is_file() else [])]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = where.exists()
    base = str(where.resolve()) if local else root.rstrip("/")
    plain = F.call_function("try_url_decode", F.regexp_replace("path", "^file:/+", "/")) if local else F.col("path")
    relative = F.substring(plain, len(base.rstrip("/")) + 2, 100_000)
    rows = found.select(relative.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), plain.alias("uri"))
    listed = git_files(root) if local else None
    if listed is not None:
        rows = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in listed], "path string")), "path", "left_semi")
    # one window over names, as many as the file index on the driver holds anyway
    return indexable(rows, patterns).withColumn("ord", F.row_number().over(Window.orderBy("path")))


def with_contents(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` instead of ``uri``. Only these files are opened, by the executors; their names, which
    the driver lists for any scan, are collected for that."""
    spark = files.sparkSession
    named = [r["uri"] for r in files.select("uri").collect()]
    if not named:
        return files.drop("uri").withColumn("content", F.lit(None).cast("binary"))
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", u) for u in named]
    found = spark.read.format("binaryFile").load(escaped)
    local = named[0].startswith("/")
    uri = F.call_function("try_url_decode", F.regexp_replace("path", "^file:/+", "/")) if local else F.col("path")
    return files.join(found.select(uri.alias("uri"), "content"), "uri").drop("uri")


def read_tree(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """``path, mtime, size, content, ord`` of the indexable files, of code files the first ``most`` only.

    Paths are listed, filtered, numbered and cut off before any content is read."""
    files = list_tree(spark, root)
    if most is not None:
        files = first_files(files.withColumn("markdown", scalars.extension(F.col("path")).isin(*fixed.MARKDOWN_EXTENSIONS)), most).drop("markdown")
    return with_contents(files)
