"""Command line: build an index, or ask one of the six questions of the nearest one."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession

NAME = "TESSERAE_INDEX.json"


def find_index(start: str = ".") -> Path | None:
    """The nearest index file at or above a folder."""
    here = Path(start).resolve()
    return next((p / NAME for p in (here, *here.parents) if (p / NAME).is_file()), None)


# Sizes in thousands of tokens, by default, least, and most for use here and elsewhere.
SIZE_K, LEAST_K, MOST_K, MOST_ELSEWHERE_K = 50, 1, 100, 800


def size_flag(prompt: str, remembered: int | None = None) -> tuple[int | None, bool | None, str]:
    """The size that ``-i`` or ``-ic`` in a prompt asks for, whether it is for use elsewhere (c), and the prompt without
    the flag. Without a number ``-i`` takes the remembered size."""
    m = re.search(r"-i(c?)(\d+)?(?:\s|$)", prompt)
    if not m:
        return None, None, prompt
    elsewhere = m[1] == "c"
    size = int(m[2]) if m[2] else SIZE_K if elsewhere else remembered or SIZE_K
    return min(max(size, LEAST_K), MOST_ELSEWHERE_K if elsewhere else MOST_K), elsewhere, re.sub(r"-ic?\d*\s*", "", prompt).strip()


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae")
    sub = top.add_subparsers(dest="command", required=True)
    make = sub.add_parser("build")
    make.add_argument("root", nargs="?", default=".")
    make.add_argument("--size-k", type=int)
    for name, what, depth in (("who-calls", "symbol", 1), ("blast-radius", "symbol", 3), ("deps", "file", 5)):
        one = sub.add_parser(name)
        one.add_argument(what)
        one.add_argument("--depth", type=int, default=depth)
    sub.add_parser("dead-code")
    search = sub.add_parser("search")
    search.add_argument("pattern")
    search.add_argument("--max", type=int, default=50)
    sub.add_parser("summary").add_argument("file")
    return top


def by_depth(rows) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, depth in rows:
        out.setdefault(f"depth_{depth}", []).append(name)
    return out


def answer(index, args: argparse.Namespace):
    if args.command == "who-calls":
        return [r[0] for r in index.who_calls(args.symbol, args.depth).collect()]
    if args.command == "blast-radius":
        return by_depth(index.blast_radius(args.symbol, args.depth).collect())
    if args.command == "dead-code":
        return [r[0] for r in index.dead_code().collect()]
    if args.command == "deps":
        return by_depth(index.dependency_chain(args.file, args.depth).collect())
    if args.command == "search":
        return [r.asDict() for r in index.search_symbols(args.pattern, args.max).collect()]
    found = index.file_summary(args.file).drop("path").collect()
    return found[0].asDict() if found else None


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    from tesserae.plans.index import build
    from tesserae.sources import dense

    if args.command != "build" and find_index() is None:
        print("no index here or above; run build first", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    if args.command == "build":
        out = dense.export(build(spark, args.root), str(Path(args.root) / NAME), args.root, target_k=args.size_k)
        print("\n".join(dense.summary(out)))
        return 0
    said = answer(dense.read_json(spark, str(find_index())), args)
    if said is None:
        print("unknown file", file=sys.stderr)
        return 1
    print(json.dumps(said, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
