import time

import pytest

from spindrift.operators import braces, symbols

GOLDEN = {
    "typescript": (
        """export abstract class Widget<T> extends Base {
  private x = { y: 1 };
  abstract foo(): void;
}
export interface Foo { a: number; m(): void }
export type Bar = string | number
enum Color { Red }
const obj = { go() { return 1; }, x: 2 };
namespace N { export function deep() {} }
describe("x", () => { function within() { } });
const z = 1
function nosemi() { }
export class Long
  extends Base {
  async *gen() { yield "/* } */"; }
}
""",
        [(1, 1, "Widget", "class", None), (3, 3, "foo", "method", "Widget"), (5, 5, "Foo", "interface", None), (6, 6, "Bar", "type", None), (7, 7, "Color", "enum", None), (8, 8, "go", "method", None), (9, 9, "deep", "function", "N"),
         (10, 10, "within", "function", None), (12, 12, "nosemi", "function", None), (13, 13, "Long", "class", None), (15, 15, "gen", "method", "Long")],
    ),
    "java": (
        "public class Calc {\n  private final Foo f = new Foo() { public void run() {} };\n  abstract int sub(int a);\n  interface In { void x(); }\n  @interface Mark { }\n  String s = \"class X {\"; // } class Y {\n}\nrecord P(int a) { int twice() { return 2 * a; } }\n",
        [(2, 2, "run", "method", "Calc"), (3, 3, "sub", "method", "Calc"), (4, 4, "In", "interface", "Calc"), (5, 5, "Mark", "type", "Calc"), (8, 8, "twice", "method", "P")],
    ),
    "c_sharp": (
        "namespace A.B;\nclass Foo {\n  public int Y => 1;\n  [Test]\n  public void T() { var s = @\"}\"\"{\"; }\n}\npublic record P(int A);\ndelegate void D(int x);\nstruct S { int a; }\nenum E { A }\n",
        [(3, 3, "Y", "field", "Foo"), (4, 5, "T", "method", "Foo"), (7, 7, "P", "class", None), (8, 8, "D", "type", None), (9, 9, "S", "struct", None), (10, 10, "E", "enum", None)],
    ),
    "c": (
        '#include "util.h"\n#define X {\ntypedef struct Point { int x; } Point;\nenum Color { RED };\nstatic int helper(int a) { return a; }\nint main(int argc, char **argv) {\n  return helper(argc);\n}\n',
        [(3, 3, "Point", "type", None), (4, 4, "Color", "enum", None), (5, 5, "helper", "function", None), (6, 8, "main", "function", None)],
    ),
    "cpp": ("template <typename T> T most(T a) { return a; }\nstruct S { ~S() {} };\nenum class E { A };\n", [(1, 1, "most", "function", None), (2, 2, "~S", "function", "S"), (3, 3, "E", "enum", None)]),
    "php": ("<?php\nnamespace App;\ninterface Shape { public function area(): float; }\nclass Circle implements Shape {\n  public function area(): float { return 1.0; } # }\n}\nfunction helper($x) { return $x; }\n", [(3, 3, "Shape", "interface", None), (5, 5, "area", "method", "Circle"), (7, 7, "helper", "function", None)]),
    "swift": ("class A: B {\n  init(x: Int) { }\n  func go() -> Int { return 1 }\n}\nprotocol P { func x() }\nextension A { func z() {} }\n", [(2, 2, "init", "method", "A"), (3, 3, "go", "function", "A"), (5, 5, "P", "interface", None), (6, 6, "z", "function", "A")]),
    "rust": ("struct Unit;\ntype X = u8;\nenum E { A }\nfn raw() { let s = r#\"}\"#; }\nimpl T for E { fn a() { match x { 'c' => {} } } }\n", [(1, 1, "Unit", "struct", None), (2, 2, "X", "type", None), (3, 3, "E", "enum", None), (4, 4, "raw", "function", None), (5, 5, "a", "function", None)]),
    "go": ("type ID int\ntype (\n  A int\n)\nvar x = map[string]int{\"a\": 1}\nfunc F() { }\n", [(1, 1, "ID", "type", None), (2, 4, "A", "type", None), (6, 6, "F", "function", None)]),
}


@pytest.mark.parametrize("language", GOLDEN)
def test_symbols_of_brace_languages(language):
    source, want = GOLDEN[language]
    assert [tuple(s[:5]) for s in braces.symbols(source, language)] == want


@pytest.mark.parametrize("language", braces.RULES)
def test_odd_and_long_sources_take_time_in_proportion(language):
    assert braces.symbols("", language) == [] and braces.symbols("}}}} ) { ( \" ' `", language) is not None
    for text in ("{" * 100_000, "( " * 100_000, "a b " * 50_000, "x = [\n" + "1,\n" * 100_000, "word\n" * 50_000, "* & " * 50_000):
        began = time.perf_counter()
        braces.symbols(text, language)
        assert time.perf_counter() - began < 5, text[:10]


def test_chunker_takes_languages_from_a_registry(spark):
    own = {"ruby": lambda source: [braces.Symbol(1, 2, "found", "method", None, 0, len(source))]}
    files = spark.createDataFrame([("a.rb", "def found\nend"), ("b.ts", "function f() { }")], "path string, contents string")
    assert {(r["path"], r["symbol"]) for r in symbols.chunk_symbols(files, by_language=own).collect()} == {("a.rb", "found"), ("b.ts", None)}
    assert {(r["path"], r["symbol"]) for r in symbols.chunk_symbols(files).collect()} == {("a.rb", None), ("b.ts", "f")}


def test_python_symbols_and_fallback(spark):
    source = "import os\n\n@deco\ndef f(x):\n    return x\n\nclass A(B):\n    '''doc'''\n    def m(self):\n        pass\n"
    rows = symbols.chunk_symbols(spark.createDataFrame([("a.py", source), ("b.py", "def broken(:\n"), ("c.txt", "one\ntwo"), ("d.py", ""), ("e.py", None)], "path string, contents string")).collect()
    assert {(r["path"], r["start_line"], r["end_line"], r["symbol"], r["kind"], r["parent"]) for r in rows} == {
        ("a.py", 3, 5, "f", "function", None), ("a.py", 7, 7, "A", "class", None), ("a.py", 9, 10, "m", "function", "A"), ("b.py", 1, 2, None, None, None), ("c.txt", 1, 2, None, None, None)
    }


def test_relative_imports(spark):
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib"), ("src/a.ts", "./none"), ("src/a.ts", "react")], "path string, specifier string")
    indexed = spark.createDataFrame([("src/b.tsx",), ("src/b.ts",), ("lib/index.ts",)], "path string")
    assert {tuple(r) for r in symbols.resolved_imports(imports, indexed).collect()} == {("src/a.ts", "./b", "src/b.ts"), ("src/a.ts", "../lib", "lib/index.ts")}


def test_a_table_in_one_part_is_cut_by_all_cores(spark):
    from spindrift.operators import symbols as operators

    one = spark.range(64).coalesce(1).selectExpr("concat('f', id, '.py') AS path", "'def f():\n    pass\n' AS contents")
    cut = operators.chunk_symbols(one)
    assert cut.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and cut.count() == 64
