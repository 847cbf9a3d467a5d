"""Code units of Java, Kotlin and TypeScript files, by a scanner of declarations.

Comments and literals are blanked first, so braces and keywords in them don't count;
positions stay.  A declaration runs to the brace that closes its body, or to the end
of its statement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodegrid.operators.chunking import make, segment, split

_LITERAL = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.DOTALL)
_NAME = r"[A-Za-z_$][\w$]*"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|open|override|suspend|inline|operator|infix|data|sealed|default|synchronized|native|readonly|async|export|declare|companion|enum|annotation|inner|value|tailrec|external|strictfp|transient|volatile|get|set)\s+)*"


def blank(source: str) -> str:
    return _LITERAL.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(code: str, at: int, pair: str = "{}") -> int:
    """Where the bracket that opens at ``at`` closes; the end if it doesn't."""
    level = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        level += 1 if m[0] == pair[0] else -1
        if not level:
            return m.start()
    return len(code) - 1


@dataclass
class Found:
    kind: str
    name: str
    start: int
    end: int
    body: tuple[int, int] | None
    signature: str | None = None


class Scanner:
    """Declarations at one level of a file: subclasses say what they look like."""

    language = ""
    types: dict[str, str] = {}
    anonymous_type = None

    def declarations(self, code: str, low: int, high: int, inside: str | None) -> list[Found]:
        out, at = [], low
        type_re = re.compile(rf"(?:@[\w.]+(?:\([^)]*\))?\s*)*{_MODIFIERS}(?P<key>{'|'.join(map(re.escape, self.types))})\s+(?P<name>{_NAME})")
        while at < high:
            while at < high and (code[at].isspace() or code[at] in ";}"):
                at += 1
            if at >= high:
                break
            if (m := type_re.match(code, at, high)) and self.type_allowed(m):
                found = self.type_found(code, m, high)
            else:
                found = self.function(code, at, high, inside)
            if found:
                out.append(found)
                at = found.end + 1
            else:
                at = self.skip(code, at, high)
        return out

    def type_allowed(self, m: re.Match) -> bool:
        return True

    def type_found(self, code: str, m: re.Match, high: int) -> Found:
        rest = m.end()
        while rest < high and code[rest] not in "{;\n" or (rest < high and code[rest] == "\n" and self.goes_on(code, rest, high)):
            rest = closing(code, rest, "()") + 1 if code[rest] == "(" else rest + 1
        has_body = rest < high and code[rest] == "{"
        end = closing(code, rest) if has_body else max(m.end() - 1, rest - 1)
        return Found(self.types[m["key"]], m["name"], m.start(), end, (rest + 1, end) if has_body else None)

    def goes_on(self, code: str, at: int, high: int) -> bool:
        """If a declaration's head goes on after a line feed."""
        after = code[at:high].lstrip()
        return after[:1] in ("{", ":", ",") or after.startswith(("extends", "implements", "where", "permits")) or code[:at].rstrip().endswith((",", ":"))

    def function(self, code: str, at: int, high: int, inside: str | None) -> Found | None:
        return None

    def skip(self, code: str, at: int, high: int) -> int:
        """Past a statement that isn't a declaration."""
        while at < high and code[at] not in ";\n{(":
            at += 1
        if at < high and code[at] == "{":
            return closing(code, at) + 1
        if at < high and code[at] == "(":
            return closing(code, at, "()") + 1
        return at + 1

    def units(self, path: str, source: str, limit: int = 512) -> list[dict]:
        code, lines = blank(source), source.split("\n")
        last = len(lines) - (lines[-1] == "")
        out = [make(path, "file", path.rsplit("/", 1)[-1], path, 1, max(1, last), source, self.language)]
        line_of = lambda at: source.count("\n", 0, at) + 1

        def visit(low: int, high: int, owner: Found | None) -> None:
            for f in self.declarations(code, low, high, owner and owner.name):
                kind = f.kind if f.kind != "function" else "method" if owner else "function"
                a, b = line_of(f.start), line_of(f.end)
                name = f"{owner.name}.{f.name}" if owner else f.name
                doc = None if self.undocumented(owner) and f.kind == "function" else comment_before(source, f.start)
                unit = make(path, kind, f.name, name, a, b, segment(lines, a, b), self.language, f.signature, doc)
                out.append(unit)
                if f.kind == "function" and f.body:
                    out.extend(split(unit, lines, limit, statements(code, *f.body, line_of)))
                elif f.body:
                    visit(*f.body, f)

        visit(0, len(code), None)
        return out

    def undocumented(self, owner: Found | None) -> bool:
        return False


def statements(code: str, low: int, high: int, line_of) -> list[tuple[int, int]]:
    """First and last lines of the statements of a body: they end at a semicolon, a closing brace, or a line feed outside brackets."""
    out, start, at = [], None, low
    while at < high:
        c = code[at]
        if start is None and not c.isspace():
            start = at
        if c in "([{":
            at = min(closing(code, at, {"(": "()", "[": "[]", "{": "{}"}[c]), high - 1)
            rest = code[at + 1 : high].lstrip(" \t")
            if c == "{" and not re.match(r"[\n]?\s*(?:else|catch|finally|while)\b|[.;,)]", rest):
                out.append((line_of(start), line_of(at)))
                start = None
        elif c == ";" or (c == "\n" and start is not None and not re.match(r"\s*[.?:&|+]", code[at:high])):
            if start is not None:
                out.append((line_of(start), line_of(at - (c == "\n"))))
            start = None
        at += 1
    if start is not None:
        out.append((line_of(start), line_of(high - 1)))
    return out


def comment_before(source: str, at: int) -> str | None:
    """The text of a ``/** */`` comment directly before a declaration."""
    before = source[:at].rstrip()
    if not before.endswith("*/"):
        return None
    start = before.rfind("/*")
    if not before.startswith("/**", start):
        return None
    lines = [x.strip() for x in before[start + 3 : -2].split("\n")]
    return "\n".join(re.sub(r"^\*\s?", "", x) for x in lines).strip() or None


class Java(Scanner):
    language = "java"
    # Enumerations and records are classes here.
    types = {"class": "class", "interface": "interface", "enum": "class", "@interface": "interface"}
    _function = re.compile(
        rf"(?:@[\w.]+(?:\([^)]*\))?\s*)*{_MODIFIERS}(?:<[^>{{}}]*>\s*)?(?:(?P<ret>{_NAME}(?:\.{_NAME})*(?:\s*<[^;{{}}()]*>)?(?:\s*\[\s*\])*)\s+)?(?P<name>{_NAME})\s*\("
    )

    def function(self, code: str, at: int, high: int, inside: str | None) -> Found | None:
        m = self._function.match(code, at, high)
        if not inside or not m or (m["ret"] is None and m["name"] != inside) or m["ret"] in ("return", "new", "throw", "else"):
            return None
        close = closing(code, m.end() - 1, "()")
        rest = close + 1
        while rest < high and code[rest] not in "{;":
            rest += 1
        parameters = re.sub(r"\s+", " ", code[m.end() - 1 : close + 1])
        sign = f"{parameters}: {m['ret']}" if m["ret"] else parameters
        if rest < high and code[rest] == "{":
            end = closing(code, rest)
            return Found("function", m["name"], at, end, (rest + 1, end), sign)
        return Found("function", m["name"], at, min(rest, high - 1), None, sign)


class Kotlin(Scanner):
    language = "kotlin"
    types = {"class": "class", "interface": "interface", "object": "object"}
    _function = re.compile(rf"(?:@[\w.]+(?:\([^)]*\))?\s*)*{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?(?P<name>{_NAME})\s*\(")
    _result = re.compile(r"\s*:\s*(?P<ret>[\w.]+(?:<[^{}=]*>)?\??)")

    def function(self, code: str, at: int, high: int, inside: str | None) -> Found | None:
        m = self._function.match(code, at, high)
        if not m:
            return None
        close = closing(code, m.end() - 1, "()")
        sign, rest = code[m.end() - 1 : close + 1], close + 1
        if r := self._result.match(code, rest, high):
            sign, rest = f"{sign}: {r['ret']}", r.end()
        tail = re.compile(r"\s*([={])").match(code, rest, high)
        if tail and tail[1] == "{":
            end = closing(code, tail.start(1))
            return Found("function", m["name"], at, end, (tail.start(1) + 1, end), sign)
        end = code.find("\n", rest, high) if tail else rest
        return Found("function", m["name"], at, (high if end < 0 else end) - 1, None, sign)


class TypeScript(Scanner):
    language = "typescript"
    types = {"class": "class", "interface": "interface"}
    _function = re.compile(rf"(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^(]*>)?\s*\(")
    _method = re.compile(rf"(?:@[\w.]+(?:\([^)]*\))?\s*)*{_MODIFIERS}\*?\s*(?P<name>#?{_NAME})\s*\??\s*(?:<[^(]*>)?\s*\(")

    def type_allowed(self, m: re.Match) -> bool:
        # Exported and abstract declarations are wrapped, and not visited.
        return not re.match(r"(?:@|export|abstract|declare)", m[0])

    def function(self, code: str, at: int, high: int, inside: str | None) -> Found | None:
        m = (self._method if inside else self._function).match(code, at, high)
        if not m or m["name"] in ("if", "for", "while", "switch", "return", "catch"):
            return None
        close = closing(code, m.end() - 1, "()")
        r = re.compile(r"\s*:\s*[^{;=\n]+").match(code, close + 1, high)
        sign = code[m.end() - 1 : close + 1] + (r[0].strip() if r else "")
        rest = r.end() if r else close + 1
        while rest < high and code[rest].isspace():
            rest += 1
        if rest < high and code[rest] == "{":
            end = closing(code, rest)
            return Found("function", m["name"], at, end, (rest + 1, end), sign)
        return Found("function", m["name"], at, min(rest, high - 1), None, sign) if inside else None

    def undocumented(self, owner: Found | None) -> bool:
        return owner is not None and owner.kind == "interface"
