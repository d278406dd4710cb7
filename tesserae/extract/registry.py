"""Parsers by extension, and their use on a table of files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tesserae.extract import python, script, shell
from tesserae.extract.rows import Found, Symbol

Parser = Callable[[str], Found]

ROW = "path string, kind string, name string, owner string, line int, signature string, doc string, decorators array<string>, inherits array<string>, value_type string, values array<string>, calls array<string>, attrs map<string,string>, ord int"


def python_parser(text: str) -> Found:
    """By the syntax tree, or by lines if V2_AST_PARSER is 0 where the parser runs."""
    return python.by_lines(text) if os.environ.get("V2_AST_PARSER", "1") == "0" else python.extract(text)


PARSERS: dict[str, Parser] = {".py": python_parser, **dict.fromkeys((".js", ".jsx", ".ts", ".tsx"), script.extract), **dict.fromkeys((".sh", ".bash"), shell.extract)}


def register_parser(ext: str, parser: Parser) -> None:
    """Use ``parser`` for files of this extension, in place of any other."""
    PARSERS[ext] = parser


def from_tool_output(text: str) -> Found:
    """Functions in the JSON of a structural search tool: name and parameters as metavariables, lines from 0."""
    found = Found()
    for match in json.loads(text or "[]"):
        held = match.get("metaVariables", {})
        if name := held.get("single", {}).get("NAME", {}).get("text", ""):
            line = match.get("range", {}).get("start", {}).get("line", 0)
            found.add(Symbol("function", name, line=line + 1, signature=f"({held.get('multi', {}).get('PARAMS', '')})"))
    return found


def parse(text: str, ext: str) -> Found | None:
    parser = PARSERS.get(ext)
    return parser(text) if parser else None


def extract(files: DataFrame) -> DataFrame:
    """Rows of symbols and imports (kinds import and source) of ``files`` (path, ext, content). One pass without a
    shuffle; a file that its parser fails on gives one row of kind ``failed``, and files are parsed one at a time."""
    parsers = dict(PARSERS)

    kind = to_arrow_schema(StructType.fromDDL(ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                parser = parsers.get(file["ext"])
                if parser is None:
                    continue
                try:
                    found = parser(bytes(file["content"] or b"").decode("utf-8", "ignore")).records()
                except Exception as e:  # a parser's failure must not end the job
                    found = [asdict(Symbol("failed", type(e).__name__)) | {"ord": 0}]
                rows = [{"path": file["path"], **r, "attrs": list(r["attrs"].items())} for r in found]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select("path", "ext", "content").mapInArrow(run, ROW)


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("kind").isin("import", "source", "failed"))


def imports_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("import", "source")).select("path", "ord", F.col("name").alias("module"), "kind")
