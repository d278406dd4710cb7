"""The index of a source tree: tables, how they are built, and the six questions they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.extract import registry
from tesserae.functions import fixed, scalars
from tesserae.operators import graphs, incremental, rank, stats, traverse
from tesserae.sources import listing
from tesserae.storage import cut

TABLES = ("files", "symbols", "imports", "call_edges", "xfile_edges", "dep_edges", "docs", "directories", "importance")


class CodeIndex:
    """The tables, as DataFrames, and queries over them. Every query is a plan; nothing is collected here."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def edges(self) -> DataFrame:
        """Callers by bare and by qualified names; the two kinds of names never meet."""
        return self.tables["call_edges"].select("src", "dst").unionByName(self.tables["xfile_edges"].select("src", "dst"))

    def who_calls(self, symbol: str, depth: int = 1) -> DataFrame:
        return traverse.who_calls(self.edges(), symbol, depth, stored=True).orderBy("symbol")

    def blast_radius(self, symbol: str, max_depth: int = 3) -> DataFrame:
        return traverse.blast_radius(self.edges(), symbol, max_depth, stored=True).orderBy("depth", "symbol")

    def dead_code(self) -> DataFrame:
        return graphs.dead_symbols(self.tables["symbols"], self.tables["call_edges"], self.tables["xfile_edges"]).orderBy("symbol")

    def dependency_chain(self, path: str, max_depth: int = 5) -> DataFrame:
        return traverse.dependency_chain(self.tables["dep_edges"], path, max_depth, stored=True).orderBy("depth", "target")

    def search_symbols(self, pattern: str, max_results: int = 50) -> DataFrame:
        order = self.tables["files"].select("path", F.col("ord").alias("file_ord"))
        return graphs.search(self.tables["symbols"].join(order, "path"), pattern, max_results)

    def file_summary(self, path: str) -> DataFrame:
        """One row, or none for an unknown path. Only this file's rows are aggregated."""
        one = lambda name: self.tables[name].where(F.col("path") == path)
        return graphs.file_summaries(one("files"), one("symbols"), one("imports"))

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeIndex:
        return cls({name: spark.read.parquet(f"{path}/{name}") for name in TABLES})


def file_table(tree: DataFrame) -> DataFrame:
    """What is known of files without their contents. ``tree``: path, ord, and what else it carries."""
    path = F.col("path")
    ext = scalars.extension(path)
    language = scalars.language_name(ext)
    return tree.select(
        "*", scalars.directory(path).alias("dir"), scalars.file_name(path).alias("name"), scalars.stem(path).alias("stem"), ext.alias("ext"), language.alias("language"),
        scalars.language_letter(language).alias("lang_letter"), scalars.file_purpose(path).alias("purpose"), ext.isin(*fixed.MARKDOWN_EXTENSIONS).alias("markdown"), ext.isin(*fixed.PARSED_LANGUAGES).alias("parseable"),
    )


def build(spark: SparkSession, root: str, previous: DataFrame | None = None, max_files: int = fixed.MAX_FILES, damping: float = 0.85) -> CodeIndex:
    """Index the tree below ``root``. With ``previous`` (rows of an earlier ``parsed_rows`` with the files' hashes) only
    files of other content are parsed."""
    tree = file_table(listing.read_tree(spark, root, max_files))
    tree = cut(tree.withColumn("content_hash", scalars.content_hash(F.col("content"))), "tree")  # read and hashed once
    return assemble(tree, parsed_rows(tree, previous))


def parsed_rows(tree: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Extracted rows with ``content_hash``; rows of files whose path and hash ``previous`` has are taken from there."""
    code = tree.where("parseable")
    if previous is None:
        fresh = code
    else:
        fresh = code.join(previous.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")
    rows = registry.extract(fresh).join(fresh.select("path", "content_hash"), "path")
    if previous is not None:
        rows = rows.unionByName(previous.join(code.select("path", "content_hash"), ["path", "content_hash"], "left_semi").select(*rows.columns))
    return cut(rows, "parsed")


def assemble(tree: DataFrame, rows: DataFrame, pagerank_iterations: int = 20) -> CodeIndex:
    """All tables from files and extracted rows."""
    symbols, imports = registry.symbols_of(rows).drop("content_hash"), registry.imports_of(rows)
    full = symbols.where("kind in ('function', 'class')").select("path").distinct().withColumn("has", F.lit(True))
    failed = rows.where("kind = 'failed'").select("path").distinct().withColumn("failed", F.lit(True))
    files = tree.drop("content").join(full, "path", "left").join(failed, "path", "left")
    files = cut(files.withColumn("parsed", F.coalesce("has", F.lit(False))).withColumn("listed_only", ~F.col("parseable") | F.coalesce("failed", F.lit(False))).drop("has", "failed"), "files")
    plain = imports.where("kind = 'import'").join(files.where("parsed").select("path"), "path", "left_semi")
    code = files.where("not markdown")
    edges = graphs.call_edges(symbols.withColumn("called_by", F.array().cast("array<string>")))
    symbols = cut(graphs.with_callers(symbols, edges), "symbols")
    calls = cut(graphs.call_edges(symbols), "calls")
    targets = graphs.import_targets(plain, graphs.module_map(code), code)
    across = cut(graphs.xfile_edges(symbols, targets), "across")
    deps = graphs.resolve_imports(plain, code)
    docs = tree.where("markdown").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("t")).select("path", scalars.sections(F.col("t")).alias("sections"), scalars.hints(F.col("t")).alias("hints"))
    counts = stats.directory_counts(code).withColumnRenamed("files", "file_count")
    directories = counts.join(stats.directory_purposes(code), "dir", "left").select(F.col("dir").alias("path"), "purpose", "file_count")
    importance = rank.top_symbols(rank.pagerank(calls.select("src", "dst").unionByName(across.select("src", "dst")), pagerank_iterations))
    return CodeIndex({"files": files, "symbols": symbols, "imports": imports.join(files.where("parsed").select("path", F.lit(True).alias("exported")), "path", "left"), "call_edges": calls, "xfile_edges": across, "dep_edges": deps, "docs": docs, "directories": directories, "importance": importance})


def stats_of(index: CodeIndex) -> dict:
    """The counters of an index: a few rows."""
    counts: dict = {"fully_parsed": {}, "listed_only": {}}
    for r in stats.language_stats(index.files.where("not markdown")).collect():
        counts[r["status"]][r["language"]] = r["n"]
    one = stats.totals(index.files).first()
    return {"total_files": one["files"] - one["markdown"], "total_directories": one["directories"], "markdown_files": one["markdown"], **counts}


def is_current(index_hash: str | None, tree: DataFrame, requested_k: int | None = None, last_k: int | None = None) -> bool:
    """Whether an index of this hash still holds for the tree."""
    now = incremental.files_hash(tree).first()["files_hash"]
    return not incremental.is_stale(index_hash, now, requested_k, last_k)
