"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, payment-card and phone numbers in the texts. How strongly a
term (a run of letters, in lower case) reveals an entity is estimated from the corpus: over distinct texts, the
pointwise mutual information of term and entity, ``log2(p(term, entity) / (p(term) p(entity)))``, against the entity's
own information ``-log2 p(entity)``. A term whose share reaches ``disclosure``, and that stands in at least ``support``
distinct texts with the entity, discloses it; every occurrence of such a term is a span of kind ``term`` beside those
of the entities. In the sanitised text entities are generalised to their kind and disclosing terms removed.

Patterns never cross a line end, and matches are leftmost and non-overlapping for each kind. Offsets are code points,
ends exclusive; places of n matches take n times the root of n steps. Nulls count as empty texts and give no span.
Repeated rows get equal spans and count as one text. An empty table gives an empty table. Everything is built of SQL
functions. A term's count is made by joining the words of all texts with the candidate terms only, so rows grow with
the matches; terms too frequent to disclose an entity are told by their count before they are paired with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.quality import let
from tesserae.storage import cut

KINDS = ("email", "ip", "card", "phone")
# The kinds' patterns. A match can only start at the start of a run of its first class, or where the last one ended
# (\G): other starts can't match if those don't, so long runs aren't scanned again from each of their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of a kind has in it, quick to test.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.lit(True)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(digits), F.lit(19))), F.lit(0), add) % 10 == 0


def spans_of(kind: str, text: Column) -> Column:
    """The valid matches of one kind, with their places: what stands between matches gives the offsets."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(text.rlike(HINTS[kind]), placed(found, F.split(text, PATTERNS[kind], -1), kind, KINDS.index(kind), lambda v: valid(kind, v))).otherwise(F.array().cast(SPAN))


def placed(found: Column, between: Column, kind: str, rank: int, keep) -> Column:
    """Matches with their offsets, of which ``keep`` holds. Running sums are taken in chunks of about the root of
    their number, and over the chunks."""
    summed = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def rows(x: Column) -> Column:
        m, g, sizes, chunk = x["m"], x["g"], x["sizes"], x["chunk"]
        places = F.sequence(F.lit(0), F.ceil(F.size(sizes) / chunk).cast("int"))

        def of(starts: Column) -> Column:
            def row(v: Column, i: Column) -> Column:
                c = F.floor(i / chunk).cast("int")
                start = starts[c] + summed(F.slice(sizes, c * chunk + 1, i - c * chunk)) + F.length(g[i])
                return let(start, lambda at: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(v)).alias("end"), F.lit(kind).alias("kind"), v.alias("value")))

            return F.transform(m, lambda v, i: F.when(keep(v), row(v, i)))

        sums = F.transform(places, lambda c: summed(F.slice(sizes, c * chunk + 1, chunk)))
        return let(let(sums, lambda s: F.transform(places, lambda c: summed(F.slice(s, F.lit(1), c)))), of)

    sized = let(F.struct(found.alias("m"), between.alias("g")), lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.transform(x["m"], lambda v, i: F.length(v) + F.length(x["g"][i])).alias("sizes"), F.ceil(F.sqrt(F.size(x["m"]) + F.lit(1.0))).cast("int").alias("chunk")))
    return F.filter(let(sized, rows), lambda r: r.isNotNull())


def base_spans(text: Column) -> Column:
    """All kinds' spans by start, then kind as listed."""
    return F.array_sort(F.concat(*[spans_of(k, text) for k in KINDS]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def words(text: Column) -> Column:
    """The distinct runs of letters, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")


def entity(span: Column) -> Column:
    """What two spellings of one entity have in common."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def disclosing(docs: DataFrame, disclosure: float, support: int, small: int) -> tuple[DataFrame, DataFrame]:
    """``i, h, term`` for each text with a disclosing term, and ``term, entity, ratio``. ``docs``: i, t, h."""
    hint = "|".join(f"(?:{HINTS[k]})" for k in KINDS)
    marked = docs.where(F.col("t").rlike(hint)).select("h", "t", base_spans(F.col("t")).alias("s")).where(F.size("s") > 0)
    # the entities' own letters, which only addresses have, aren't terms
    bare = F.regexp_replace("t", PATTERNS["email"], " ")
    near = cut(marked.select("h", F.array_distinct(F.transform("s", entity)).alias("entities"), words(bare).alias("w")), "pii-texts-with")
    texts = float(max(1, docs.select("h").distinct().count()))
    ic = F.log2(F.lit(texts) / F.col("with_entity"))
    pmi = lambda with_term: F.log2(F.col("both") * F.lit(texts) / (F.col(with_term) * F.col("with_entity")))
    own = near.select("h", F.explode("entities").alias("entity")).distinct()
    counts = own.groupBy("entity").agg(F.count("*").alias("with_entity")).where((F.col("with_entity") >= support) & (ic > 0))
    own = own.join(counts, "entity")
    # A term stands in at least as many texts as among these, and with the entity in at most all the entity's: pairs
    # that fall short by these counts do so in the corpus, so they are never made, and common words not counted.
    spoken = near.select("h", F.explode("w").alias("term")).distinct()
    here = spoken.groupBy("term").agg(F.count("*").alias("with_term_here")).where(F.col("with_term_here") >= support)
    most = F.pow(F.lit(texts), F.lit(1 - disclosure)) * F.pow("with_entity", F.lit(disclosure)) * (1 + 1e-9)
    met = own.withColumn("most", most).join(spoken.join(here, "term"), "h").where(F.col("with_term_here") <= F.col("most"))
    together = met.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term_here").alias("with_term_here"))
    together = together.where((F.col("both") >= support) & (pmi("with_term_here") >= disclosure * ic)).select("entity", "term", "both", "with_entity")
    together = cut(together, "pii-pairs")
    known = together.select("term").distinct()
    # the words of all texts are only sent anywhere if the candidate terms are too many to be sent to them
    count = known.count()
    known = F.broadcast(known) if count <= small else known
    where = cut(docs.select("i", "h", F.explode(words(F.col("t"))).alias("term")).join(known, "term"), "pii-terms")
    having = where.select("h", "term").distinct().groupBy("term").agg(F.count("*").alias("with_term"))
    pairs = together.join(having, "term").where(pmi("with_term") >= disclosure * ic).select("term", "entity", (pmi("with_term") / ic).alias("ratio"))
    pairs = cut(pairs, "pii-disclosing")
    return where.join(pairs.select("term").distinct(), "term", "left_semi"), pairs


def term_spans(text: Column, terms: Column) -> Column:
    """Each occurrence of each term as a whole run of letters, whatever its case."""
    return placed(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), F.split(text, r"\p{L}+", -1), "term", len(KINDS), lambda v: F.array_contains(terms, F.lower(v)))


def sanitise(docs: DataFrame, disclosure: float = 0.9, support: int = 3, small: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the four counts, ``base_sha256``, ``spans``, ``n_term``; ``found``, the spans as structs by start;
    and ``sanitised``, the text with entities generalised and disclosing terms removed, null where the text is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t"), F.xxhash64(text).alias("h"), F.col(text_col).alias("raw"))
    base = rows.select("i", "h", "t", F.col("raw").isNull().alias("none"), base_spans(F.col("t")).alias("s"))
    hits, _ = disclosing(rows, disclosure, support, small)
    terms = hits.groupBy(F.col("i").alias("j"), F.col("h").alias("g")).agg(F.sort_array(F.collect_set("term")).alias("w"))
    terms = cut(terms, "pii-texts")
    few = terms.count() <= small
    found = rows.join(F.broadcast(terms) if few else terms, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g"))).select("j", "g", term_spans(F.col("t"), F.col("w")).alias("x")).dropDuplicates(["j", "g"])
    both = base.join(found, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g")), "left")
    apart = F.filter(F.coalesce("x", F.array().cast(SPAN)), lambda x: ~F.exists("s", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    both = both.select("i", "t", "none", "s", apart.alias("x"))
    every = F.array_sort(F.concat("s", "x"))
    said = F.when(~F.col("none"), redacted(F.col("t"), every))
    of = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return both.select(F.col("i").alias(id_col), *[of(k) for k in KINDS], F.sha2(joined(F.col("s")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("x").cast("long").alias("n_term"), every.alias("found"), said.alias("sanitised"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and terms removed; of overlapping spans the first counts.
    ``spans``: sorted structs as from ``base_spans``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        said = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        more = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), said)
        return F.when(s["start"] >= acc["at"], F.struct(more.alias("out"), s["end"].alias("at"))).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
