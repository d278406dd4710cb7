"""Generic inputs of the operators, made of the benchmark tables: a key is a symbol, a foreign key is a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from each row to the rows that its keys name: order, customer, part, supplier, nation, region."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.where(f"{x} is not null and {y} is not null").select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    items = t("lineitem")
    parts = [
        edge(t("orders"), "o:", "o_orderkey", "c:", "o_custkey"), edge(items, "o:", "l_orderkey", "p:", "l_partkey"), edge(items, "p:", "l_partkey", "s:", "l_suppkey"),
        edge(t("customer"), "c:", "c_custkey", "n:", "c_nationkey"), edge(t("supplier"), "s:", "s_suppkey", "n:", "s_nationkey"), edge(t("nation"), "n:", "n_nationkey", "r:", "n_regionkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of event types that follow each other for a user: a graph with cycles."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.lag("event_type").over(by).alias("src"), F.col("event_type").alias("dst"))
    return pairs.where("src is not null and dst is not null").distinct()


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in a sparse graph with long cycles: each to three times its number and one, modulo a prime."""
    users = table(spark, sf_dir, "events").where("user_id is not null").select("user_id").distinct()
    return users.select(F.concat(F.lit("u:"), F.col("user_id") % 97).alias("src"), F.concat(F.lit("u:"), (F.col("user_id") * 3 + 1) % 97).alias("dst")).distinct()


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, rank``: each brand as a file, ranked by name."""
    names = table(spark, sf_dir, "part").where("p_brand is not null").select(F.col("p_brand").alias("path")).distinct()
    return names.withColumn("rank", F.row_number().over(Window.orderBy("path")))  # a few dozen brands


def brand_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, ord, module``: the brand of rank i imports those of ranks i + 1 and 2 i."""
    b = brands(spark, sf_dir)
    wanted = b.select("path", F.explode(F.array_distinct(F.array(F.col("rank") + 1, 2 * F.col("rank")))).alias("to"))
    met = wanted.join(b.select(F.col("path").alias("module"), F.col("rank").alias("to")), "to")
    return met.select("path", F.col("to").alias("ord"), "module").where("path != module")


def brand_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions: the part names of a brand, called by nothing of their own; and the part types, which call names."""
    part = table(spark, sf_dir, "part").where("p_brand is not null and p_name is not null and p_type is not null")
    names = part.groupBy(F.col("p_brand").alias("path"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"), F.array().cast("array<string>").alias("calls"))
    types = part.groupBy(F.col("p_brand").alias("path"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("ord"), F.sort_array(F.collect_set("p_name")).alias("calls"))
    return names.unionByName(types).withColumn("kind", F.lit("function")).withColumn("owner", F.lit(None).cast("string")).withColumn("called_by", F.array().cast("array<string>"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a symbol of its brand; small parts are classes."""
    kind = F.when(F.col("p_size") <= 5, "class").otherwise("function")
    brand = F.coalesce(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"), F.lit(0))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), kind.alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("line"), F.col("p_partkey").alias("ord"), brand.alias("file_ord"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file named by its source, id and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("d"), F.pmod(F.col("doc_id"), F.lit(7)).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("md"))))
    return docs.select(path.alias("path"), F.col("doc_id").alias("ord"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.col("lang").isin("en", "fr").alias("parsed"), (F.coalesce("lang", F.lit("")) != "en").alias("listed_only"), F.col("lang").isNull().alias("markdown"), "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL, without its scheme and query, as a path, with a suffix by its number."""
    pages = table(spark, sf_dir, "pages")
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/index.html", "/test_main.py", "/settings.json", "/model.ts", "/notes.md", "/util.sh", "/build/out.js")]), (F.col("page_id") % 7 + 1).cast("int"))
    return pages.select(F.concat(plain, tail).alias("path"), F.col("page_id").alias("ord"), "html")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as the current files, and a snapshot in which every 7th text was other, every 11th file isn't yet,
    every 5th time is older, and some files are there that are gone now."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    now = docs.select(F.lit("r").alias("root"), path.alias("path"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    time = F.col("doc_id").cast("double") - F.when(F.col("doc_id") % 5 == 0, 1.0).when(F.col("doc_id") % 7 == 0, 1.0).otherwise(0.0)
    old = docs.where("doc_id % 11 != 0").select(F.lit("r").alias("root"), path.alias("path"), time.alias("mtime"), F.col("n_chars").alias("size"), F.sha2(text, 256).alias("content_hash"))
    gone = docs.where("doc_id % 13 = 0").select(F.lit("r").alias("root"), F.concat(path, F.lit("-old")).alias("path"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash"))
    return now, old.unionByName(gone).withColumn("tool_version", F.lit("1"))
