import textwrap

import pytest

from lodegrid.operators.chunking import merge, tokens
from lodegrid.operators.extraction import extract, failures, nodes_of, parse
from tests.fixtures import node

SOURCES = {
    "python": '''"""Module."""
import os

class Shape:
    """A shape."""
    def area(self, x: int = 1, *, unit: str) -> float:
        """Its area."""
        return 0.0

    @property
    def name(self): return "n"

if True:
    def hidden(): pass

async def go(a, /, b, *rest, **more):
    def inner(): pass
    return a
''',
    "java": '''package a;
/**
 * Stores things.
 */
public interface Store<T> {
    T find(int id);
}
public class Cart extends Base implements Store<String> {
    private int n = 3; // class Fake { void no() {} }
    public Cart(int n) { this.n = n; }
    /** Adds. */
    @Override
    public List<String> add(String a, int b) throws Error {
        if (a == "}") { return null; }
        return new ArrayList<>();
    }
    static class Inner { void deep() { } }
}
enum Kind { A, B }
''',
    "kotlin": '''package a
/** Greets. */
interface Greeter { fun greet(name: String): String }
data class Person(val name: String, val age: Int) : Greeter {
    override fun greet(name: String): String = "hi $name"
    fun grow(by: Int) {
        age += by
    }
}
object Registry {
    fun all(): List<Person>? { return null }
}
fun top(x: Int): Int { return x }
''',
    "typescript": '''/** Greets. */
interface Greeter {
    greet(name: string): string;
}
class Person implements Greeter {
    private name: string = "x";
    constructor(name: string) { this.name = name; }
    greet(name: string): string { return `hi ${name} }`; }
    async wait<T>(ms: number): Promise<T> { if (ms) { return null; } return null; }
}
export class Hidden { run(): void {} }
function top(x: number): number { return x; }
const arrow = (x: number) => x;
''',
    "ruby": '''# Things.
module Shop
  # A cart.
  class Cart
    def initialize(items = [])
      @items = items
      if items.empty?
        puts "end"
      end
    end

    def empty? = @items.none?

    def self.build(*args)
      new(args).tap do |c|
        c.freeze
      end
    end
  end
end

def top(x)
  x
end
''',
}
EXPECTED = {
    "python": [("file", "f", 1, 19), ("class", "Shape", 4, 11), ("method", "Shape.area", 6, 8), ("method", "Shape.name", 11, 11), ("function", "go", 16, 18)],
    "java": [
        ("file", "f", 1, 19), ("interface", "Store", 5, 7), ("method", "Store.find", 6, 6), ("class", "Cart", 8, 18), ("method", "Cart.Cart", 10, 10), ("method", "Cart.add", 12, 16),
        ("class", "Cart.Inner", 17, 17), ("method", "Inner.deep", 17, 17), ("class", "Kind", 19, 19),
    ],
    "kotlin": [
        ("file", "f", 1, 13), ("interface", "Greeter", 3, 3), ("method", "Greeter.greet", 3, 3), ("class", "Person", 4, 9), ("method", "Person.greet", 5, 5), ("method", "Person.grow", 6, 8),
        ("object", "Registry", 10, 12), ("method", "Registry.all", 11, 11), ("function", "top", 13, 13),
    ],
    "typescript": [
        ("file", "f", 1, 13), ("interface", "Greeter", 2, 4), ("method", "Greeter.greet", 3, 3), ("class", "Person", 5, 10), ("method", "Person.constructor", 7, 7),
        ("method", "Person.greet", 8, 8), ("method", "Person.wait", 9, 9), ("function", "top", 12, 12),
    ],
    "ruby": [("file", "f", 1, 24), ("class", "Shop", 2, 20), ("class", "Shop.Cart", 4, 19), ("method", "Cart.initialize", 5, 10), ("method", "Cart.empty?", 12, 12), ("method", "Cart.build", 14, 18), ("function", "top", 22, 24)],
}


@pytest.mark.parametrize("language", SOURCES)
def test_units(language):
    found = parse("f", language, SOURCES[language])
    plain = [n for n in found if not n["name"].startswith("merged_")]
    got = [(n["node_type"], n["qualified_name"], n["start_line"], n["end_line"]) for n in plain]
    expected = EXPECTED[language]
    last = SOURCES[language].count("\n")
    assert got == [("file", "f", 1, last), *expected[1:]]
    for n in found:
        assert len(n["id"].split("::")) == 3 and 1 <= n["start_line"] <= n["end_line"]
        assert len(n["content_hash"]) == 64


def test_signatures_and_docs():
    by = {lang: {n["qualified_name"]: n for n in parse("f", lang, SOURCES[lang])} for lang in SOURCES}
    assert by["python"]["Shape.area"]["signature"] == "(self, x: int, *, unit: str) -> float"
    assert by["python"]["go"]["signature"] == "(a, /, b, *rest, **more)"
    assert by["python"]["Shape"]["docstring"] == "A shape."
    assert by["java"]["Cart.add"]["signature"] == "(String a, int b): List<String>"
    assert by["java"]["Cart.add"]["docstring"] == "Adds."
    assert by["java"]["Store"]["docstring"] == "Stores things."
    assert by["kotlin"]["Registry.all"]["signature"] == "(): List<Person>?"
    assert by["typescript"]["Greeter.greet"]["signature"] == "(name: string): string"
    assert by["ruby"]["Shop.Cart"]["docstring"] == "A cart."
    assert by["ruby"]["top"]["signature"] == "(x)"


def test_chunks_of_large_units():
    body = "\n".join(f"    value_{i} = compute({i})" for i in range(40))
    found = parse("f", "python", f"def big(a):\n{body}\n    return a\n", 60)
    chunks = [n for n in found if n["name"].startswith("chunk_")]
    assert found[1]["qualified_name"] == "big" and len(chunks) > 1
    assert all(tokens(c["raw_source"]) <= 60 and c["signature"] == "(a)" for c in chunks)
    assert [c["start_line"] for c in chunks[1:]] == [c["end_line"] + 1 for c in chunks[:-1]]
    assert (chunks[0]["start_line"], chunks[-1]["end_line"]) == (2, 42)
    for language, source in (
        ("kotlin", "fun big(): Int {\n" + "    val x = compute(1)\n" * 20 + "    return x\n}\n"), ("typescript", "function big(): number {\n" + "    const x = compute(1);\n" * 20 + "    return x;\n}\n"),
        ("java", "class A {\n  int big() {\n" + "    int x = compute(1);\n" * 20 + "    return x;\n  }\n}\n"), ("ruby", "def big\n" + "  x = compute(1)\n" * 20 + "  x\nend\n"),
    ):
        assert any(n["name"].startswith("chunk_") for n in parse("f", language, source, 30)), language


def test_merge_of_small_siblings():
    make = lambda name, size, owner="A": node("f", "method", name, 1, 1, qualified=f"{owner}.{name}", raw_source="x" * size)
    nodes = [node("f", "file", "f", 1, 9), make("a", 8), make("b", 8), make("big", 4000), make("c", 8), make("d", 8, "B"), make("e", 8, "B")]
    found = merge(nodes, 100)
    assert [n["qualified_name"] for n in found[len(nodes):]] == ["A.merged_1", "B.merged_2"]
    assert found[:len(nodes)] == nodes
    assert merge([make("a", 8)], 100) == [make("a", 8)]


def test_last_definition_wins_and_failures(spark):
    files = spark.createDataFrame([("a.py", "python", "def f():\n    return 1\n\ndef f():\n    return 2\n"), ("b.py", "python", "def ("), ("c.py", "python", "")], "path string, language string, text string")
    found = extract(files).cache()
    rows = nodes_of(found).collect()
    twice = [r for r in rows if r.qualified_name == "f"]
    assert len(twice) == 1 and twice[0].start_line == 4
    assert [r.path for r in failures(found).collect()] == ["b.py"]
    assert [r.file_path for r in rows if r.node_type == "file"] == ["a.py", "c.py"]


def test_dedent_is_no_error():
    assert parse("f", "python", textwrap.dedent("x = 1")) is not None
