"""Shell scripts: functions of both styles, exports, upper-case variables and included files."""

from __future__ import annotations

import re

from tesserae.extract.rows import Found, Symbol, called

# How the constructs are written.
STYLES = (re.compile(r"^(\w+)\s*\(\)\s*\{?"), re.compile(r"^function\s+(\w+)\s*\{?"))
EXPORT = re.compile(r"^export\s+([A-Z_][A-Z0-9_]*)(=(.*))?")
VARIABLE = re.compile(r"^([A-Z_][A-Z0-9_]*)=(.+)$")
INCLUDE = re.compile(r"^(?:source|\.)\s+(?:(['\"])(?P<quoted>[^'\"]+)\1|(?P<made>\$\([^)]+\)\S*)|(?P<plain>\S+))")
PARAMETER = re.compile(r"\$(\d+)")
PARAMETER_LINES = 20


def head(line: str) -> str | None:
    return next((m[1] for p in STYLES if (m := p.match(line))), None)


def body_after(lines: list[str], start: int) -> tuple[list[str], bool]:
    """The lines from the first opening brace below a definition to the one that evens the braces, and whether any
    was there. A brace on the definition's own line isn't seen, and then nothing of the body is."""
    depth, body = 0, []
    for line in lines[start:]:
        depth += line.count("{")
        if body or "{" in line:
            body.append(line)
        if "}" in line:
            depth -= line.count("}")
            if depth <= 0:
                return body, True
    return body, False


def parameters(lines: list[str], start: int) -> str:
    body, closed = body_after(lines[: start + PARAMETER_LINES - 1], start)
    used = {int(n) for line in (body[:-1] if closed else body) for n in PARAMETER.findall(line)} - {0}
    return "(" + " ".join("$1" if k == 1 else f"${{{k}}}" for k in range(1, max(used, default=0) + 1)) + ")"


def export_type(value: str) -> str:
    return "str" if value[0] in "'\"" else "number" if value.isdigit() else "value"


def extract(text: str) -> Found:
    found, lines = Found(), text.split("\n")
    defined = {n for line in lines if (n := head(line))}
    for k, line in enumerate(lines):
        bare = line.strip()
        if not bare or bare.startswith("#!"):
            continue
        if name := head(bare):
            above = lines[k - 1].strip() if k else ""
            body, _ = body_after(lines, k + 1)
            found.add(Symbol("function", name, signature=parameters(lines, k + 1), doc=above[1:].strip() or None if above.startswith("#") else None, calls=called("\n".join(body), defined, "shell")))
        elif m := EXPORT.match(bare):
            if m[3]:
                found.add(Symbol("export", m[1], value_type=export_type(m[3])))
        elif m := VARIABLE.match(bare):
            if not found.has("export", m[1]) and not found.has("variable", m[1]):
                found.add(Symbol("variable", m[1]))
        elif (m := INCLUDE.match(bare)) and (name := (m["quoted"] or m["made"] or m["plain"]).strip()) and ("source", name) not in found.imports:
            found.bring(name, "source")
    return found
