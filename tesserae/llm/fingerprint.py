"""Document fingerprints: Merkle trees over sentences, paragraphs and sections.

A paragraph is a line with its line end, its leaves are its sentences, a section is ``section`` paragraphs, and the
root is the hash of the sections' hashes; every node is the SHA-256 of its children's. A sentence of over 256
characters is cut further, by its content, so that an edit leaves the other pieces as they are: after words (where it
has no space, characters) whose MD5 starts with 0, one in sixteen, and after each 256th. Every character is in one leaf
and cuts depend on the text alone, so equal roots mean equal texts, and where roots differ, the differing sections and
leaves tell where.

A fingerprint is the text ``root:sections:leaves`` with the root's 64 hex digits, and 12 of each section and leaf,
joined by dots. The likeness of two fingerprints is the Dice coefficient of their sets of leaves, 1 for equal roots.

Nulls count as empty texts; the empty text has one empty leaf. Ids are whole numbers; others are refused. Equal texts have equal fingerprints, so repeated rows
do. Rows of equal id follow each other by a hash of their text. Empty tables give empty tables. Everything is built of
SQL functions; a very long text is one row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


#: Sentences of more characters are cut further.
LONG = 256


def pieces(sentence: Column) -> Column:
    """The sentence alone, or what its content parts it into if it is long. A line end, which only a paragraph's last
    sentence has, and only at its end, marks the cuts, as none of the pieces can hold another."""
    units = F.when(F.contains(F.rtrim(F.translate(sentence, "\n", "")), F.lit(" ")), F.split(sentence, r"(?<=\x20)", -1)).otherwise(F.split(sentence, "", -1))
    marked = F.transform(units, lambda u, i: F.when((F.substring(F.md5(u), 1, 1) == "0") | (i % 256 == 255), F.concat(u, F.lit("\n"))).otherwise(u))
    return F.when(F.length(sentence) > LONG, F.split(F.concat_ws("", marked), "\n", -1)).otherwise(F.array(sentence))


def fingerprint(text: Column, section: int = 16) -> Column:
    """The Merkle tree's ``root:sections:leaves``."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), r"(?<=\n)", -1)
    sentences = lambda p: F.split(p, r"(?<=[.!?;:]\x20)", -1)
    parts = lambda p: F.when(F.length(p) > LONG, F.flatten(F.transform(sentences(p), pieces))).otherwise(sentences(p))
    tree = F.transform(paragraphs, lambda p: F.transform(parts(p), lambda s: F.sha2(s, 256)))
    # one pass for each level: the nested hashes are bound to a lambda's argument, so none is computed twice
    def sections(t: Column) -> Column:
        nodes = F.transform(t, lambda leaves: F.sha2(F.concat_ws(",", leaves), 256))
        count = F.ceil(F.size(t) / section).cast("int")
        return F.transform(F.array(nodes), lambda n: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.concat_ws(",", F.slice(n, i * section + 1, section)), 256)))[0]

    short = lambda hashes: F.concat_ws(".", F.transform(hashes, lambda h: F.substring(h, 1, 12)))
    said = F.transform(F.array(tree), lambda t: F.transform(F.array(sections(t)), lambda s: F.concat_ws(":", F.sha2(F.concat_ws(",", s), 256), short(s), short(F.flatten(t))))[0])
    return said[0]


def root(mark: Column) -> Column:
    return F.substring_index(mark, ":", 1)


def sections(mark: Column) -> Column:
    return F.split(F.split(mark, ":")[1], r"\.")


def leaves(mark: Column) -> Column:
    return F.split(F.substring_index(mark, ":", -1), r"\.")


def changed_sections(a: Column, b: Column) -> Column:
    """Places from 0 of the sections of ``a`` that ``b`` lacks at that place."""
    other = sections(b)
    places = F.transform(sections(a), lambda h, i: F.when(F.coalesce(F.get(other, i) != h, F.lit(True)), i))
    return F.filter(places, lambda i: i.isNotNull())


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the leaf sets; 1 for equal roots."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    return F.when(root(a) == root(b), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def with_next(docs: DataFrame, id_col: str, carry: list[str], tie: str, rows_per_bucket: int = 2000, made: dict[str, Column] | None = None) -> DataFrame:
    """Add ``next_<c>`` for each column of ``carry``: its value in the following row by descending id (ties by
    ``tie``, nulls last), and in the first row after the last.

    Rows are dealt to id ranges, so no task gets them all; each range also gets the first row of the one below. Columns
    of ``made`` are added when these rows are told, so they are made once a row."""
    made = made or {}
    spark = docs.sparkSession
    count = docs.agg(F.count("*").alias("n")).first()["n"]
    buckets = max(1, min(1 << 16, count // rows_per_bucket))
    cuts: list[int] = []
    if buckets > 1:
        at = [k / buckets for k in range(1, buckets)]
        cuts = sorted(set(docs.agg(F.percentile_approx(id_col, at, 20_000).alias("c")).first()["c"] or []))
    bits = len(cuts).bit_length()
    # binary search for the number of cuts below the id; nulls go to the lowest range
    padded = cuts + [cuts[-1]] * ((1 << bits) - 1 - len(cuts)) if cuts else []
    if cuts:
        literal = F.expr("array(" + ",".join(f"{c}L" for c in padded) + ")")
        steps = F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)])
        bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(literal, at + step) < F.col(id_col), at + step).otherwise(at))
    else:
        bucket = F.lit(0)
    rows = docs.withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
    firsts = rows.groupBy("_bucket").agg(F.max(id_col).alias("_id")).orderBy(F.desc("_bucket")).collect()  # one row for each range
    if not firsts:
        return rows.drop("_bucket").withColumns(made).select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    below = [(r["_bucket"], firsts[(k - 1) % len(firsts)]["_bucket"], r["_id"]) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(below, "_bucket int, _to int, _id long")
    ghost = rows.join(F.broadcast(heads), "_bucket").where(F.col(id_col).eqNullSafe(F.col("_id")))
    one = Window.partitionBy("_bucket").orderBy(tie)
    ghost = ghost.withColumn("_k", F.row_number().over(one)).where("_k = 1").withColumn("_bucket", F.col("_to")).drop("_k", "_to", "_id").withColumn("_ghost", F.lit(True))
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc_nulls_last(id_col), tie)
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghost).withColumns(made)
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).where(~F.col("_ghost")).drop("_ghost", "_bucket")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section: int = 16) -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: each text against
    itself with its last third replaced by the start of the next one, and against the next one."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t"), F.xxhash64(text).alias("h"))
    rows = with_next(rows, "i", ["t", "f"], "h", made={"f": fingerprint(F.col("t"), section)})
    n = F.length("t").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("t").substr(F.lit(1), (n - third).cast("int")), F.col("next_t").substr(F.lit(1), third))
    rows = rows.select("i", n.alias("n"), "f", "next_f", edited.alias("e")).withColumn("g", fingerprint(F.col("e"), section))
    return rows.select(
        F.col("i").alias(id_col), F.col("n").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), F.col("f").alias("fingerprint"),
        F.col("g").alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
        F.concat_ws(",", changed_sections(F.col("f"), F.col("g")).cast("array<string>")).alias("edited_sections"),
    )
