"""Code units of Python files, by the standard library's parser."""

from __future__ import annotations

import ast

from lodegrid.operators.chunking import make, segment, split


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Parameters with annotations, without defaults, and the result."""
    a = node.args
    show = lambda x, mark="": f"{mark}{x.arg}" + (f": {ast.unparse(x.annotation)}" if x.annotation else "")
    parts = [show(x) for x in a.posonlyargs] + (["/"] if a.posonlyargs else []) + [show(x) for x in a.args]
    parts += [show(a.vararg, "*")] if a.vararg else ["*"] if a.kwonlyargs else []
    parts += [show(x) for x in a.kwonlyargs] + ([show(a.kwarg, "**")] if a.kwarg else [])
    return f"({', '.join(parts)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def units(path: str, source: str, limit: int = 512) -> list[dict] | None:
    """The file, its top-level classes with their methods, and functions; None if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    lines = source.split("\n")
    last = len(lines) - (lines[-1] == "")
    out = [make(path, "file", path.rsplit("/", 1)[-1], path, 1, max(1, last), source, "python", docstring=ast.get_docstring(tree))]
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def add(node: ast.stmt, kind: str, owner: str | None, sign: str | None) -> None:
        name = f"{owner}.{node.name}" if owner else node.name
        unit = make(path, kind, node.name, name, node.lineno, node.end_lineno, segment(lines, node.lineno, node.end_lineno), "python", sign, ast.get_docstring(node))
        out.append(unit)
        if kind != "class":
            out.extend(split(unit, lines, limit, [(s.lineno, s.end_lineno) for s in node.body]))

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            add(node, "class", None, None)
            for inner in node.body:
                if isinstance(inner, functions):
                    add(inner, "method", node.name, signature(inner))
        elif isinstance(node, functions):
            add(node, "function", None, signature(node))
    return out
