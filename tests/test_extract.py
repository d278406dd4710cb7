import json

import pytest

from tesserae.extract import python, registry, rows, script, shell

SOURCE = '''
import os, sys as system
from typing import List
from . import sibling
from .near import thing
MAX = 10
NAMES = ["a"]
label: str = "x"
_hidden = 1

@cached(1)
@pkg.mark
def top(a, b: int = 2, *args, c=3, **kw) -> str:
    """First line.
    Second."""
    def inner():
        return helper()
    print(helper(a))
    return os.path.join(a)

async def helper(x, /, y): pass

class Base(Thing, other.Thing):
    """A class."""
    LIMIT = 5
    size: int = 1
    plain = 2
    def run(self, n: int) -> None:
        self.go(n)
    def go(self, n): top(n)

class Color(Enum):
    """Colors."""
    RED = 1
    GREEN = 2
    def show(self): pass
'''


def test_python_by_tree():
    f = python.by_tree(SOURCE)
    assert [m for _, m in f.imports] == ["os", "sys", "typing", "near"]
    top, helper = f.of("function")
    assert (top.name, top.signature, top.doc, top.decorators, top.calls) == ("top", "(a, b: int = 2, *args, c = 3, **kw) -> str", "First line.", ["cached", "pkg.mark"], ["helper"])
    assert (helper.signature, helper.line) == ("async (y)", 21)
    (base,) = f.of("class")
    assert (base.inherits, base.doc) == (["Thing", "other.Thing"], "A class.")
    assert [(m.name, m.signature, m.calls) for m in f.of("method", "Base")] == [("run", "(n: int) -> None", ["go"]), ("go", "(n)", ["top"])]
    assert [s.name for s in f.of("class_constant", "Base")] == ["LIMIT"]
    assert [s.name for s in f.of("property", "Base")] == ["size", "plain"]
    (color,) = f.of("enum")
    assert (color.values, color.doc, f.of("method", "Color")) == (["RED", "GREEN"], "Colors.", [])
    assert {s.name: s.value_type for s in f.of("constant")} == {"MAX": "number", "NAMES": "collection"}
    assert [s.name for s in f.of("variable")] == ["label"]


def test_every_call_is_kept_on_demand():
    assert python.by_tree(SOURCE, every_call=True).of("function")[0].calls == ["helper", "join"]


BROKEN = '''
import os
import a.b as ab, c
Alias = Dict[str, int]
COUNT = 3  # three
name: str = "n"

class Err(Exception):
    """Bad."""
    CODE = 1
    def __repr__(self):
        return ""
    @abstractmethod
    def work(
        self,
        n: int,
    ) -> int:
        """Does."""
        return run(n)

class Shape(MyEnum):
    ROUND = 1

def run(n):
    work(n)
    if n: print(n
'''


def test_python_by_lines():
    with pytest.raises(SyntaxError):
        python.by_tree(BROKEN)
    f = python.extract(BROKEN)
    assert [m for _, m in f.imports] == ["os", "a.b", "c"]
    assert [(s.name, s.signature) for s in f.of("type_alias")] == [("Alias", "Dict[str, int]")]
    assert [(s.name, s.value_type) for s in f.of("constant")] == [("COUNT", "number")]
    err = next(s for s in f.of("class") if s.name == "Err")
    assert (err.inherits, err.doc, err.attrs) == (["Exception"], "Bad.", {"type": "exception", "abstract": "true"})
    (work,) = f.of("method", "Err")
    assert (work.name, work.signature, work.line, work.doc, work.calls) == ("work", "( self, n: int, ) -> int".replace("( ", "(").replace(", )", ",)"), 17, "Does.", ["run"])
    assert [s.calls for s in f.of("function") if s.name == "run"] == [["work"]]


SCRIPT = '''
import React from 'react';
import { a, b } from "./lib";
const fs = require('fs');
/** About this file. */
const LIMIT = 5;
let count = 0;
export type Id = string;
export interface Shape extends Base, Other { x: number }
enum Color { Red, Green = 2 }
export async function load(url, options) {
  return parse(url);
}
const parse = (text: string): Item => {
  return JSON.parse(text);
}
class Store extends AppError {
  static MAX = 3;
  constructor(x) {
    this.x = x;
  }
  async save(item) {
    { load(item); }
  }
}
'''


def test_script():
    f = script.extract(SCRIPT)
    assert [m for _, m in f.imports] == ["react", "./lib", "fs"]
    assert [(s.name, s.signature, s.calls) for s in f.of("function")] == [("load", "async (url, options)", ["parse"]), ("parse", "(text: string): Item", ["parse"])]
    (store,) = f.of("class")
    assert (store.line, store.inherits, store.attrs, store.doc) == (17, ["AppError"], {"type": "exception"}, "About this file. */")
    assert [m.name for m in f.of("method", "Store")] == ["constructor", "save", "__init__"]
    assert [s.name for s in f.of("class_constant", "Store")] == ["MAX"]
    assert [(s.name, s.values) for s in f.of("enum")] == [("Color", ["Red", "Green"])]
    assert [(s.name, s.inherits) for s in f.of("interface")] == [("Shape", ["Base", "Other"])]
    assert [s.name for s in f.of("variable")] == ["fs", "count", "parse"]


SHELL = '''#!/bin/bash
export HOME_DIR="/x"
export COUNT=3
LIMIT=5
source "lib.sh"
. ./other.sh
. ./other.sh
# Says hello.
greet() {
  echo $1 $3
}
function main
{
  greet "$2"
  if true; then { x; } fi
}
'''


def test_shell():
    f = shell.extract(SHELL)
    assert f.imports == [("source", "lib.sh"), ("source", "./other.sh")]
    assert {s.name: s.value_type for s in f.of("export")} == {"HOME_DIR": "str", "COUNT": "number"}
    assert [s.name for s in f.of("variable")] == ["LIMIT"]
    greet, main = f.of("function")
    assert (greet.signature, greet.doc, greet.calls) == ("()", "Says hello.", [])  # the brace stands on its own line only
    assert (main.signature, main.calls) == ("($1 ${2})", ["greet"])


def test_braces():
    assert rows.matching_brace("{a{b}c}", 1) == 6
    assert rows.matching_brace("{a{b}c", 1) == 1
    assert rows.matching_brace("{" + "x" * 50 + "}", 1, 10) == 1
    assert rows.matching_brace_line(["f() {", "  {", "  }", "}", "x"], 0) == 3
    assert rows.matching_brace_line(["{ {", "}"], 0) == 1
    assert rows.matching_brace_line(["} {", "}"], 0, 2) == 1


def test_tool_output():
    text = json.dumps([{"metaVariables": {"single": {"NAME": {"text": "run"}}, "multi": {"PARAMS": "a"}}, "range": {"start": {"line": 4}}}, {}])
    (run,) = registry.from_tool_output(text).of("function")
    assert (run.name, run.line, run.signature) == ("run", 5, "(a)")


def test_extract_table(spark):
    files = [("a.py", ".py", bytearray(SOURCE.encode())), ("b.sh", ".sh", bytearray(SHELL.encode())), ("c.txt", ".txt", bytearray(b"x")), ("d.py", ".py", bytearray(b"\xff\xfedef f(): pass")), ("e.py", ".py", None)]
    out = registry.extract(spark.createDataFrame(files, "path string, ext string, content binary"))
    assert sorted(r["path"] for r in registry.symbols_of(out).where("kind = 'function'").select("path").distinct().collect()) == ["a.py", "b.sh", "d.py"]
    assert [r["module"] for r in registry.imports_of(out).where("path = 'a.py'").orderBy("ord").collect()] == ["os", "sys", "typing", "near"]
    assert registry.extract(spark.createDataFrame([], "path string, ext string, content binary")).count() == 0


def test_registered_parser():
    registry.register_parser(".zz", lambda text: rows.Found())
    assert registry.parse("x", ".zz").records() == []
    assert registry.parse("x", ".unknown") is None
    del registry.PARSERS[".zz"]
