"""Scalar functions as column expressions. They stay in the JVM and fold into the plan around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import fixed


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value of a key, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def any_in(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def exists_any(texts: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(texts, lambda t: any_in(F.lower(t), parts))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path without its last part; ``.`` for a file at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """With its dot; empty for names without one, with it only at the start, or only at the end."""
    return F.regexp_extract(file_name(path), r"(?<=[^.])\.[^.]+$", 0)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def language_name(ext: Column) -> Column:
    return F.coalesce(lookup(ext, fixed.PARSED_LANGUAGES), F.nullif(F.substring(ext, 2, 100), F.lit("")), F.lit("unknown"))


def language_letter(language: Column) -> Column:
    return F.coalesce(lookup(language, fixed.LANGUAGE_LETTERS), F.lit("u"))


def file_purpose(path: Column) -> Column:
    name = F.lower(stem(path))
    out = F.when(name.isin(*fixed.ENTRY_STEMS), "Application entry point")
    for parts, purpose in fixed.FILE_PURPOSES:
        out = out.when(any_in(name, parts), purpose)
    return out


def directory_purpose(path: Column, files: Column) -> Column:
    """By the directory's name, else by a known name within it, else by its files' names; else null."""
    name = F.lower(file_name(path))
    by_part = None
    for part, purpose in fixed.DIRECTORY_PURPOSES.items():
        by_part = F.when(name.contains(part), purpose) if by_part is None else by_part.when(name.contains(part), purpose)
    for parts, purpose in fixed.CONTENT_PURPOSES:
        by_part = by_part.when(exists_any(files, parts), purpose)
    return F.coalesce(lookup(name, fixed.DIRECTORY_PURPOSES), by_part)


def constant_type(text: Column) -> Column:
    """collection, str, number or value."""
    digits = F.translate(text, ".-", "")
    return F.when(text.rlike(r"^[{\[]"), "collection").when(text.rlike("^['\"`]"), "str").when(digits.rlike(r"^[0-9]+$"), "number").otherwise("value")


def truncate_doc(doc: Column, most: int = 80) -> Column:
    clean = F.replace(F.btrim(F.coalesce(doc, F.lit("")), F.lit(" \t\n\r\x0b\x0c")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 3), F.lit("..."))).otherwise(clean)


def abbreviate_path(path: Column) -> Column:
    for long, short in fixed.PATH_ABBREVIATIONS:
        path = F.replace(path, F.lit(long), F.lit(short))
    return path


def dense_signature(signature: Column) -> Column:
    return F.replace(F.replace(F.coalesce(signature, F.lit("()")), F.lit(" -> "), F.lit(">")), F.lit(": "), F.lit(":"))


def dense_function(name: Column, line: Column, signature: Column, calls: Column, doc: Column) -> Column:
    """``name:line:signature:calls:doc``."""
    said = F.coalesce(F.array_join(calls, ","), F.lit(""))
    return F.concat_ws(":", name, F.coalesce(line, F.lit(0)).cast("string"), dense_signature(signature), said, truncate_doc(doc))


def dense_name(text: Column) -> Column:
    return F.substring_index(text, ":", 1)


def dense_line(text: Column) -> Column:
    return F.coalesce(F.get(F.split(text, ":"), F.lit(1)), F.lit("0"))


def modules_of(path: Column) -> Column:
    """The dotted names that a Python file answers to: its own, and its package's for ``__init__``."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    package = F.regexp_replace(dotted, r"\.__init__$", "")
    return F.when(~path.endswith(".py"), F.array().cast("array<string>")).when(dotted.endswith(".__init__"), F.array(package, dotted)).otherwise(F.array(dotted))


def relative_base(module: Column, source: Column) -> Column:
    """Where a relative import points, without a suffix: ``./x``, ``../x``, else the source's own directory."""
    own = F.when(source.contains("/"), F.regexp_replace(source, "/[^/]*$", "")).otherwise("")
    steps = F.split(module, "/")
    ups = F.size(F.filter(steps, lambda p: p == ".."))
    parts = F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "/"))
    up = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0)))
    rest = F.array_join(F.filter(steps, lambda p: ~p.isin("..", ".")), "/")
    joined = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))
    return F.when(module.startswith("./"), joined(own, F.substring(module, 3, 10_000))).when(module.startswith("../"), joined(F.array_join(up, "/"), rest)).otherwise(own)


def token_estimate(size: Column) -> Column:
    """Thousands of tokens of so many characters, four to a token."""
    return F.floor(F.floor(size / 4) / 1000).cast("long")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def raw_calls(body: Column) -> Column:
    """Names that stand before a parenthesis."""
    return F.regexp_extract_all(body, F.lit(r"\b(\w+)\s*\("), F.lit(1))


def method_calls(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"\w+\.(\w+)\s*\("), F.lit(1))


def known_calls(body: Column, defined: Column, excluded: tuple[str, ...]) -> Column:
    """Sorted names called in ``body`` that ``defined`` has; ``excluded`` ones only as methods."""
    bare = F.array_except(F.array_intersect(raw_calls(body), defined), F.array(*[F.lit(x) for x in excluded]))
    return F.array_sort(F.array_union(bare, F.array_intersect(method_calls(body), defined)))


def sections(text: Column) -> Column:
    """Up to ten headings of levels 1 to 3 in the first characters."""
    return F.slice(F.regexp_extract_all(F.substring(text, 1, fixed.MARKDOWN_SCAN), F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), 1, 10)


# Phrases that name a path.
HINT_PATTERNS = (
    r"(?:located?|found?|stored?)\s+in\s+`?([\w\-\./]+)`?",
    r"`?([\w\-\./]+)`?\s+(?:contains?|houses?|holds?)",
    r"(?:see|check|look)\s+(?:in\s+)?`?([\w\-\./]+)`?\s+for",
    r"(?:file|module|component)\s+`?([\w\-\./]+)`?",
)


def hints(text: Column) -> Column:
    """Up to five paths that a document speaks of, sorted."""
    start = F.substring(text, 1, fixed.MARKDOWN_SCAN)
    found = F.array().cast("array<string>")
    for p in HINT_PATTERNS:
        found = F.array_union(found, F.regexp_extract_all(start, F.lit("(?iu)" + p), F.lit(1)))
    return F.slice(F.array_sort(F.filter(found, lambda x: x.contains("/") & ~x.startswith("http"))), 1, 5)
