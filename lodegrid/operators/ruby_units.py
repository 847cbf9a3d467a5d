"""Code units of Ruby files, by a scanner of lines that pairs openers with ``end``."""

from __future__ import annotations

import re

from lodegrid.operators.chunking import make, segment, split

_TYPE = re.compile(r"^\s*(?:class|module)\s+(?!<<)(?P<name>[A-Z]\w*(?:::[A-Z]\w*)*)")
_METHOD = re.compile(r"^\s*(?:(?:private|protected|public|private_class_method)\s+)?def\s+(?:self\.|[A-Za-z_]\w*\.)?(?P<name>[A-Za-z_]\w*[?!=]?|\[\]=?|[+\-*/%<>=!~^&|]+)\s*(?P<args>\([^)]*\))?(?P<one>\s*=\s)?")
_OPENS = re.compile(r"^\s*(?:if|unless|while|until|case|begin|for|class|module|def)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")
_LITERAL = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|#.*$')


def units(path: str, source: str, limit: int = 512) -> list[dict]:
    lines = source.split("\n")
    last = max(1, len(lines) - (lines[-1] == ""))
    out = [make(path, "file", path.rsplit("/", 1)[-1], path, 1, last, source, "ruby")]
    code = [_LITERAL.sub(lambda m: " " * len(m[0]), x) for x in lines]

    def ends(at: int) -> int:
        """The line whose ``end`` closes the opener on a line."""
        level = 0
        for i in range(at, len(code)):
            method = _METHOD.match(code[i])
            level += bool(_OPENS.search(code[i])) and not (method and method["one"])
            level -= bool(re.match(r"^\s*end\b", code[i])) or bool(re.search(r";\s*end\s*$", code[i]))
            if level <= 0:
                return i
        return len(code) - 1

    def comment(at: int) -> str | None:
        found = []
        while at > 0 and re.match(r"^\s*#", lines[at - 1]):
            at -= 1
            found.append(re.sub(r"^\s*#\s?", "", lines[at]).rstrip())
        return "\n".join(reversed(found)).strip() or None

    def visit(low: int, high: int, owner: str | None) -> None:
        i = low
        while i < high:
            if m := _TYPE.match(code[i]):
                end, name = ends(i), m["name"].split("::")[-1]
                out.append(make(path, "class", name, f"{owner}.{name}" if owner else name, i + 1, end + 1, segment(lines, i + 1, end + 1), "ruby", docstring=comment(i)))
                visit(i + 1, end, name)
                i = end + 1
            elif m := _METHOD.match(code[i]):
                end = i if m["one"] else ends(i)
                sign = lines[i][m.start("args") : m.end("args")] if m["args"] else None
                kind, name = ("method", f"{owner}.{m['name']}") if owner else ("function", m["name"])
                unit = make(path, kind, m["name"], name, i + 1, end + 1, segment(lines, i + 1, end + 1), "ruby", sign, comment(i))
                out.append(unit)
                out.extend(split(unit, lines, limit, body(i + 1, end)))
                i = end + 1
            else:
                i += 1

    def body(low: int, high: int) -> list[tuple[int, int]]:
        found, i = [], low
        while i < high:
            end = ends(i) if _OPENS.search(code[i]) else i
            if code[i].strip():
                found.append((i + 1, end + 1))
            i = end + 1
        return found

    visit(0, len(code), None)
    return out
