"""Line dedup by an exact set-similarity join.

A line is the set of its words. A line is removed if an earlier line (by document id, then line number) has Jaccard
similarity of at least ``threshold`` with it. Lines without a word stay. Steps:

1. In how many lines each word occurs is counted over all texts, in a sketch of a bounded number of counters. A word's
   rank is its counter followed by its hash, so ranks order words by rarity, and alike everywhere, which is all that the
   prefix filter needs; a word whose counter is 1 is in one line and in no match. A set is the sorted array of its ranks.
2. Lines of equal sets are one class, of which the first line stays. The sets of the most frequent lines are bounded in
   number and sent to the lines, so that no task gets all copies of one line.
3. Two sets above the threshold share a word among the rarest ``n - ceil(threshold * n) + 1`` of each (prefix filter).
   Pairs that share one are tested by length, by the word's positions, and by the number of differing bits of parity
   bitmaps, which is at most the size of the symmetric difference. What is left is verified on the words themselves.
4. So that many variants of one line aren't all paired with each other, of prefix words with more than ``few`` classes
   each class is first held against the word's earliest class only; classes without a match are then held against
   all earlier ones.
5. Sets of fewer than eight words match at most sets with one word more or less; these are found by the sets' hashes,
   with each word left out in turn, as their prefixes would be common words.

Nulls count as empty texts, repeated rows (equal id and text) as one document. Null ids come first. Empty tables give
empty tables. Ids are whole numbers; others are refused. Everything is built of SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tesserae.llm.quality import let
from tesserae.storage import cut, discard

#: White space that isn't a space or a line end.
OTHER_BLANKS = "\t\x0b\f\r"
#: Sets of fewer words match only sets that have one word more or less, at thresholds from 0.8 on.
LEAST = 8
#: At most so many line sets are sent to every task because of how often they occur.
FREQUENT = 4096

#: How hashes are written: neither a dictionary nor compression is worth its time.
PLAIN = {"parquet.enable.dictionary": "false", "compression": "none"}


def blank(text: Column) -> Column:
    """Whether the text has white space that isn't a space or a line end."""
    odd = F.contains(text, F.lit(OTHER_BLANKS[0]))
    for c in OTHER_BLANKS[1:]:
        odd = odd | F.contains(text, F.lit(c))
    return odd


def spaced(text: Column, odd: Column) -> Column:
    """The text with spaces and line ends as its only white space; ``odd``: whether it is ``blank``."""
    return F.when(odd, F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(text)


def hashes(line: Column) -> Column:
    """The words' hashes, of a line that ``spaced`` has given; splitting at one character needs no pattern. A line
    without words gives one hash. No element can be null, or functions of the array would box each element."""
    blanks = line.startswith(" ") | line.endswith(" ") | F.contains(line, F.lit("  "))
    words = F.split(F.when(blanks, F.regexp_replace(F.trim(line), " +", " ")).otherwise(line), " ")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(sets: DataFrame, bits: int) -> DataFrame:
    """One row: an array of 2**bits bytes, the logarithm of the number of lines' words (hashes s) with such a hash."""
    spark = sets.sparkSession
    words = sets.select(F.explode("s").alias("w")).select(F.col("w").bitwiseAND((1 << bits) - 1).cast("int").alias("k"))
    counts = words.groupBy("k").agg(F.count("*").alias("n"))
    code = F.when(F.col("n") <= 1, 0).otherwise(1 + F.floor(2 * F.log2("n")))
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").select("k", F.coalesce(F.least(code, F.lit(120)), F.lit(0)).cast("byte").alias("c"))
    pages = every.groupBy(F.shiftright("k", 12).alias("p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("c"))
    return cut(pages.groupBy().agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("p", "c"))), lambda x: x["c"])).alias("c")), "lines-sketch")


def at_least(a: Column, b: Column, threshold: float) -> Column:
    """The words that sets of these sizes must share."""
    return F.ceil(F.lit(threshold) / (1 + threshold) * (a + b) - 1e-9)


def near(x: dict[str, Column], y: dict[str, Column], threshold: float) -> Column:
    """Length, positional and bitmap filter of two prefix words' rows."""
    need = at_least(x["n"], y["n"], threshold)
    length = (F.least(x["n"], y["n"]) >= F.ceil(threshold * F.greatest(x["n"], y["n"]) - 1e-9))
    position = F.least(x["n"] - x["p"], y["n"] - y["p"]) >= need
    bitmap = F.bit_count(x["b"].bitwiseXOR(y["b"])) <= x["n"] + y["n"] - 2 * need
    return length & position & bitmap


def matches(pairs: DataFrame, spots: DataFrame, texts: DataFrame, threshold: float, small: int) -> DataFrame:
    """Those x of ``pairs`` (x, y: first lines of classes) for which the words' Jaccard similarity with a y reaches the
    threshold. ``spots``: o, i, h, p; ``texts``: i, h, t. Only lines that ``pairs`` names become sets."""
    ends = cut(pairs.select(F.explode(F.array("x", "y")).alias("o")).distinct(), "lines-ends")
    held = ends.count()
    few = held <= small
    wanted = spots.join(F.broadcast(ends) if few else ends, "o").groupBy(F.col("i").alias("j"), F.col("h").alias("g")).agg(F.collect_set(F.struct("o", "p")).alias("at"))
    found = texts.join(F.broadcast(wanted) if few else wanted, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g"))).select("at", F.split("t", "\n").alias("lines"))
    found = found.select(F.explode(F.transform("at", lambda a: F.struct(a["o"].alias("o"), F.get("lines", a["p"]).alias("line")))).alias("x"))
    sets = cut(found.select("x.o", F.array_distinct(hashes(F.col("x.line"))).alias("s")), "lines-sets")
    if sets.count() > held:  # of repeated rows, each has given its sets
        sets = cut(sets.dropDuplicates(["o"]), "lines-sets")
    side = lambda end: sets.select(F.col("o").alias(end), F.col("s").alias(f"s{end}"))
    shared = F.size(F.array_intersect("sx", "sy"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return both.where(shared >= at_least(F.size("sx"), F.size("sy"), threshold)).select("x").distinct()


def removed_lines(docs: DataFrame, **how) -> DataFrame:
    """``i, h, lines``: for each document (id and hash of text) its removed lines' numbers from 0, and how they match."""
    return rows_and_removed(docs, **how)[1]


def rows_and_removed(docs: DataFrame, threshold: float = 0.8, bits: int = 22, few: int = 512, small: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``i, h, n_lines`` of each row of ``docs``, so that its texts needn't be read again, and ``removed_lines``."""
    if not 0.8 <= threshold <= 1:
        raise ValueError("thresholds from 0.8 on are supported")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.select("i", F.xxhash64("t").alias("h"), "t")
    # each text is split once, into its lines' words, which the sketch and the ranks are both made of
    marked = texts.withColumn("odd", blank(F.col("t"))).select("i", "h", "odd", F.split(spaced(F.col("t"), F.col("odd")), "\n").alias("all"))
    cells = marked.select("i", "h", "odd", F.size("all").alias("n_lines"), F.posexplode("all").alias("p", "line"))
    words = cut(cells.select("i", "h", "odd", "n_lines", "p", (F.trim("line") != "").alias("some"), F.array_distinct(hashes(F.col("line"))).alias("s")), "lines-words", **PLAIN)
    seen = words.agg(F.max("i").alias("high"), F.min("i").alias("low"), F.max("p").alias("p"), F.max("odd").alias("odd")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    step = (seen["p"] or 0) + 1
    # a line's place in the order of all lines, as one number
    kind = "long" if (high - low + 2) * step < 1 << 62 else "decimal(38,0)"
    place = F.coalesce(F.col("i").cast(kind) - F.lit(low).cast(kind) + 1, F.lit(0).cast(kind)) * F.lit(step).cast(kind) + F.col("p").cast(kind)
    if seen["odd"]:
        texts = texts.withColumn("t", spaced(F.col("t"), blank(F.col("t"))))

    counters = sketch(words, bits)
    once = F.lit(1 << 56)
    # neither the word nor its counter can be null, but only this tells the planner, see ``hashes``
    rank = lambda c, h: F.coalesce(F.shiftleft(c[h.bitwiseAND((1 << bits) - 1)].cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))
    # the sketch is a subquery's value, named once, so no row holds a copy of it
    ranks = F.transform("s", lambda w: rank(F.col("sketch"), w))
    ranked = words.withColumn("sketch", counters.scalar()).select("i", "h", "n_lines", "p", place.alias("o"), "some", F.sort_array(ranks).alias("s"))
    n = F.when(F.col("some"), F.size("s")).otherwise(0)
    size = (n - F.ceil(threshold * n - 1e-9) + 1).cast("int")
    # a parity bit for each of the 64 values of the hash's six upper bits; shifts take their length modulo 64
    bitmap = F.aggregate("s", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, 50).cast("int"))))
    none = F.array().cast("array<long>")
    lines = ranked.select(
        "i", "h", "n_lines", "p", "o", n.alias("n"), F.when(n >= LEAST, bitmap).otherwise(F.lit(0).cast("long")).alias("b"), F.xxhash64("s").alias("c1"), F.xxhash64(F.lit(1), "s").alias("c2"),
        F.when(n >= LEAST, F.slice("s", F.lit(1), size)).otherwise(none).alias("a"),
        F.when(n <= LEAST, F.col("s")).alias("few"),
    )
    lines = cut(lines, "lines")
    discard(words)
    rows = lines.where("p = 0").select("i", "h", F.col("n_lines").cast("long"))
    lines = lines.where("n > 0")

    classes = cut(lines.groupBy("c1", "c2").agg(F.min("o").alias("first"), F.count("*").alias("many")).where("many > 1"), "lines-classes")
    members = lines.select("i", "h", "p", "o", "c1", "c2")
    if classes.count() <= small:
        again = members.join(F.broadcast(classes), ["c1", "c2"])
    else:  # all lines of one frequent set would meet in one task, so these sets are sent to the lines
        hot = cut(classes.orderBy(F.desc("many"), "c1", "c2").limit(FREQUENT), "lines-frequent")
        rest = members.join(F.broadcast(hot.select("c1", "c2")), ["c1", "c2"], "left_anti").join(classes, ["c1", "c2"])
        again = members.join(F.broadcast(hot), ["c1", "c2"]).unionByName(rest)
    again = cut(again.where("o > first").select("i", "h", "p", "o"), "lines-again")
    spots, copies = lines.select("o", "i", "h", "p"), again.select("o")
    first = lines.join(F.broadcast(copies) if again.count() <= small else copies, "o", "left_anti")

    # Of prefix words with at most `few` classes all pairs are tested; the rows of more common words are kept apart for
    # the two steps below, which pair no group in full, and aren't sent anywhere before they are told apart. The
    # sketch tells most words that are surely not common, so only the others are counted.
    prefix = first.where(F.size("a") > 0).select("o", "n", "b", F.posexplode("a").alias("k", "w")).where(F.col("w") >= once)
    # words with fewer occurrences than this code are surely in at most `few` classes
    surely = F.lit((1 + math.floor(2 * math.log2(few + 1))) << 56)
    # a row has the set's size and the word's position as one number, m, as rows are many
    prefix = prefix.select(F.col("w").bitwiseAND(0x7FFFFFFF).cast("int").alias("w"), "o", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("k").cast("long")).alias("m"), "b", (F.col("w") < surely).alias("sure"))
    common = cut(prefix.where("not sure").groupBy("w").agg(F.count("*").alias("many")).where(F.col("many") > few).select("w"), "lines-common")
    common = F.broadcast(common) if common.count() <= small else common
    parts = lambda m, b: {"n": F.shiftright(m, 32).cast("int"), "p": m.bitwiseAND(0x7FFFFFFF).cast("int"), "b": b}
    row = lambda end: parts(F.col(f"m{end}"), F.col(f"b{end}"))
    named = lambda df, end: df.select("w", *[F.col(c).alias(c + end) for c in ("o", "m", "b")])
    rare = prefix.join(common, "w", "left_anti").drop("sure")
    # both sides are the same plan, names included, so that its rows are sent once
    of = lambda side: parts(F.col(f"{side}.m"), F.col(f"{side}.b"))
    met = rare.alias("x").join(rare.alias("y"), F.col("x.w") == F.col("y.w")).where((F.col("y.o") < F.col("x.o")) & near(of("x"), of("y"), threshold)).select(F.col("x.o").alias("x"), F.col("y.o").alias("y"))
    shared = cut(prefix.where("not sure").drop("sure").join(common, "w", "left_semi"), "lines-shared")
    hubs = shared.groupBy("w").agg(F.min("o").alias("oy"), F.min_by("m", "o").alias("my"), F.min_by("b", "o").alias("by"))
    early = named(shared, "x").join(hubs, "w").where((F.col("ox") > F.col("oy")) & near(row("x"), row("y"), threshold)).select(F.col("ox").alias("x"), F.col("oy").alias("y"))
    pairs = met.unionByName(early).distinct()
    matched = cut(matches(cut(pairs, "lines-pairs"), spots, texts, threshold, small), "lines-matched")

    later = named(shared, "x").join(matched.withColumnRenamed("x", "ox"), "ox", "left_anti")
    late = later.join(named(shared, "y"), "w").where((F.col("oy") < F.col("ox")) & near(row("x"), row("y"), threshold)).select(F.col("ox").alias("x"), F.col("oy").alias("y")).distinct()
    more = matches(cut(late, "lines-rest"), spots, texts, threshold, small)

    # sets of under eight words: one is the other and one more
    short = first.where(F.col("n").between(4, LEAST - 1)).select("c1", "c2", "o")
    longer = first.where(F.col("n").between(5, LEAST)).select("o", "few")
    less = longer.select("o", "few", F.explode("few").alias("w")).select("o", F.array_remove("few", F.col("w")).alias("few")).select(F.xxhash64("few").alias("c1"), F.xxhash64(F.lit(1), "few").alias("c2"), F.col("o").alias("long"))
    within = less.join(short, ["c1", "c2"]).select(F.greatest("o", "long").alias("x"))

    gone = cut(matched.unionByName(more).unionByName(within).distinct().withColumnRenamed("x", "o"), "lines-near")
    close = lines.join(F.broadcast(gone) if gone.count() <= small else gone, "o", "left_semi").select("i", "h", "p", F.lit("near").alias("how"))
    every = again.select("i", "h", "p", F.lit("exact").alias("how")).unionByName(close).distinct()
    return rows, every.groupBy("i", "h").agg(F.sort_array(F.collect_set("p")).alias("lines"), F.count_if(F.col("how") == "near").alias("n_near"))


def dedup(docs: DataFrame, small: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns, less the removed lines of the text. Texts without a removed line stay as they
    are, nulls too."""
    gone = cut(removed_lines(docs, small=small, id_col=id_col, text_col=text_col, **how).select(F.col("i").alias("_gone_i"), F.col("h").alias("_gone_h"), F.col("lines").alias("_gone")), "lines-gone")
    held = gone.agg(F.count("*").alias("n"), F.sum(F.size("_gone")).alias("lines")).first()
    gone = F.broadcast(gone) if 4 * held["n"] + (held["lines"] or 0) <= 4 * small else gone  # else texts are sent to the rows, once
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # no column can clash with the ones that are added
    text = F.col(names[text_col])
    known = docs.select(*[F.col(c).alias(to) for c, to in names.items()]).withColumn("_h", F.xxhash64(F.coalesce(text, F.lit(""))))
    both = known.join(gone, F.col(names[id_col]).cast("long").eqNullSafe(F.col("_gone_i")) & (F.col("_h") == F.col("_gone_h")), "left")
    kept = let(F.split(text, "\n"), lambda a: F.concat_ws("\n", F.filter(a, lambda x, k: ~F.array_contains("_gone", k))))
    whole = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    return both.select(*[(whole if c == text_col else F.col(to)).alias(c) for c, to in names.items()])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``id_col, n_lines, n_removed, removed_lines`` (their numbers from 0, joined by commas) for each row."""
    rows, gone = rows_and_removed(docs, id_col=id_col, text_col=text_col, **how)
    both = rows.withColumnsRenamed({"i": "j", "h": "g"}).join(gone, F.col("j").eqNullSafe(F.col("i")) & (F.col("g") == F.col("h")), "left")
    return both.select(F.col("j").cast(docs.schema[id_col].dataType).alias(id_col), "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.concat_ws(",", F.col("lines").cast("array<string>")).alias("removed_lines"))
