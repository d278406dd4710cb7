"""Quality rules by distribution divergence.

Each text's histograms of character classes and of common words are held against its language's references by the
Jensen-Shannon distance (base 2, so from 0 to 1). A language's reference of classes is the mean over its texts that
pass the base rules, that of words the share of its ``top`` most frequent words over all its texts. Short texts stray
far by chance, so a limit is ``limit + slack / sqrt(n)``, and texts under ``min_words`` fail by the base rules and get
no verdict of the method.

Nulls count as empty texts. Texts of no language, or of one without a text that passes the base rules, are held
against the reference that is nearest to them by the sum of both distances; without any reference the base rules alone
decide. References, at most ``most_languages`` of them, are sent to the rows, so no task gets all texts of a language.
More languages than that are refused with a ValueError. Repeated rows get equal results; ties between equally frequent words go to the
first by code point; an empty table gives an empty table. Everything is built of SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.storage import cut

BLANK = r"[\x20\x09-\x0D]+"
#: Fixed characters of two classes.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:'\"()-!?"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is computed once."""
    return F.transform(F.array(x), body)[0]


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in ``w``. Windows are compared by 64-bit hashes."""
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def few(h: Column, twice: Column) -> Column:
        places = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return let(F.filter(places, lambda i: i.isNotNull()), covered)

    def many(h: Column) -> Column:
        def of(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of)

    def count(h: Column) -> Column:
        def by(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1) == x, F.lit(False))))
            return let(twice, lambda d: F.when(F.size(d) <= 64, few(h, d)).otherwise(many(h)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(h), by))

    return let(hashes, count)


def letters(text: Column) -> Column:
    """The runs of letters, in lower case; first and last may be empty."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def counts_of(words: Column, common: list[str]) -> Column:
    """``array<struct<w, n>>``: how often each of ``common`` stands in ``words``, if it does."""
    hits = F.sort_array(F.filter(words, lambda w: w.isin(common)))

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda w, i: F.when(F.coalesce(F.get(s, i + 1) != w, F.lit(True)), F.struct(w.alias("w"), (i + 1).alias("n")))), lambda e: e.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda x, k: F.struct(x["w"].alias("w"), (x["n"] - F.coalesce(F.get(e, k - 1)["n"], F.lit(0))).alias("n"))))

    return let(hits, runs)


def share_part(p: Column, q: Column) -> Column:
    """What one cell of two histograms adds to twice the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def assess(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, top: int = 40, class_limit: float = 0.12, class_slack: float = 2.5, word_limit: float = 0.25, word_slack: float = 2.0, most_languages: int = 4096, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance`` for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), text.alias("t"))

    # the most frequent words of each language, over all its texts: at most `top` words a language reach the driver
    spoken = rows.where("l is not null").select("l", F.explode(letters(F.col("t"))).alias("w")).where("w != ''")
    counted = cut(spoken.groupBy("l", "w").agg(F.count("*").alias("n")), "quality-words")
    whole = counted.groupBy("l").agg(F.sum("n").alias("all"))
    by = Window.partitionBy("l").orderBy(F.desc("n"), "w")
    best = counted.withColumn("k", F.row_number().over(by)).where(F.col("k") <= top)
    references = best.join(whole, "l").groupBy("l").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", (F.col("n") / F.col("all")).alias("q"))))).alias("words"))
    references = references.withColumn("all_of", total(F.map_values("words")))
    references = cut(references, "quality-reference")
    if references.count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    common = sorted({w for r in references.select(F.map_keys("words").alias("w")).collect() for w in r["w"]}) or [""]

    rows = rows.withColumn("w", F.filter(F.split("t", BLANK), lambda x: x != "")).withColumn("a", letters(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size, letter = F.length("t"), F.length(F.concat_ws("", "a"))
    solid, upper = without(F.col("t"), " \t\n\x0b\f\r"), F.regexp_count("t", F.lit(r"\p{Lu}"))
    digit, point = size - without(F.col("t"), "0123456789"), size - without(F.col("t"), PUNCTUATION)
    digest = rows.select(
        "i", "l", F.size("w").cast("long").alias("n_words"), solid.cast("long").alias("word_chars"),
        (size - without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 4, 0).otherwise(repeat_words(F.col("w"))).cast("long").alias("n_repeat_words"),
        F.array(size - solid, upper, letter - upper, digit, point, solid - letter - digit - point).cast("array<double>").alias("c"),
        F.size(F.filter("a", lambda x: x != "")).alias("spoken"), counts_of(F.col("a"), common).alias("h"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    digest = cut(digest.withColumn("base_failed", failed).withColumn("c", F.transform("c", lambda x: x / F.greatest(F.lit(1.0), total(F.col("c"))))), "quality")
    classes = digest.where("not base_failed and l is not null").groupBy("l").agg(F.array(*[F.avg(F.col("c")[k]) for k in range(6)]).alias("classes"))

    known = references.join(classes, "l").select(F.struct("l", "words", "all_of", "classes").alias("r"))
    known = cut(known.groupBy().agg(F.array_sort(F.collect_list("r"), lambda x, y: F.when(x["l"] < y["l"], -1).otherwise(1)).alias("r")), "quality-known")
    each = digest.withColumn("r", known.scalar())
    p = lambda n: n / F.greatest(F.lit(1.0), F.col("spoken").cast("double"))

    def held(r: Column) -> Column:
        """Both distances to one reference."""
        gap = total(F.transform(F.arrays_zip(F.col("c").alias("a"), r["classes"].alias("b")), lambda z: share_part(z["a"], z["b"])))
        # share here and in the reference of each reference word that the text has
        own = F.filter(F.transform("h", lambda x: F.struct(p(x["n"]).alias("p"), F.element_at(r["words"], x["w"]).alias("q"))), lambda x: x["q"].isNotNull())
        start = F.struct(F.lit(0.0).alias("said"), F.lit(0.0).alias("there"), F.lit(0.0).alias("parts"))
        add = lambda a, x: F.struct((a["said"] + x["p"]).alias("said"), (a["there"] + x["q"]).alias("there"), (a["parts"] + share_part(x["p"], x["q"])).alias("parts"))
        # words that the text lacks add their reference share in full
        spread = F.aggregate(own, start, add, lambda a: a["parts"] + share_part(1 - a["said"], 1 - r["all_of"]) + (r["all_of"] - a["there"]))
        root = lambda x: F.sqrt(F.greatest(x / 2, F.lit(0.0)))
        return let(F.struct(root(gap).alias("class"), root(spread).alias("word")), lambda d: F.struct((d["class"] + d["word"]).alias("both"), d["class"].alias("class"), d["word"].alias("word")))

    every = lambda rs: F.when(F.exists(rs, lambda r: r["l"].eqNullSafe(F.col("l"))), F.filter(rs, lambda r: r["l"].eqNullSafe(F.col("l")))).otherwise(rs)
    each = each.withColumn("d", F.array_min(F.transform(every(F.col("r")), held)))
    each = each.withColumn("class_distance", F.col("d.class")).withColumn("word_distance", F.col("d.word"))
    far = (F.col("class_distance") > class_limit + class_slack / F.sqrt(F.greatest("word_chars", F.lit(1)))) | (F.col("word_distance") > word_limit + word_slack / F.sqrt(F.greatest("n_words", F.lit(1))))
    return each.select(F.col("i").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
