"""Symbol chunks of sources in many languages, derived from the parts' table: each part is a file in the language of its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import symbols
from spindrift.plans.registry import query, table

#: For each language the ending, a source with § for the key, and what symbols it has: first and last line, name, kind, parent.
SOURCES = [
    ("ts", 'import { a } from "./b";\n// function no() {}\nexport class W§ extends Base {\n  constructor(private a: { b: string }) { super(); }\n  render(): string { return `${"}"} function z() {`; }\n  get size() {\n    if (this.x) { return 1; }\n    return 2;\n  }\n}\nexport type T§ =\n  | { a: 1 }\n  | { b: 2 };\nexport default async function main§(a: { b: number } = {}, c = () => { return 1; }) {\n  function inner() {}\n}\n',
     [(3, 3, "W§", "class", None), (4, 4, "constructor", "method", "W§"), (5, 5, "render", "method", "W§"), (6, 9, "size", "method", "W§"), (11, 13, "T§", "type", None), (14, 16, "main§", "function", None)]),
    ("go", 'package main\n\ntype User§ struct {\n  Name string\n}\nfunc (u *User§) Greet(a interface{}) string {\n  if a != nil { return "}" }\n  return `x{`\n}\nfunc Add§(a, b int) int { return a + b }\n', [(3, 5, "User§", "type", None), (6, 9, "Greet", "method", None), (10, 10, "Add§", "function", None)]),
    ("rs", "#[derive(Debug)]\npub struct User§ { name: String }\npub fn greet§<'a>(u: &'a User) -> char { '{' }\nimpl User {\n  pub fn new() -> Self { User { name: String::new() } }\n}\nmod inner§ { pub(crate) fn f() {} }\ntrait T { fn x(&self); }\n",
     [(2, 2, "User§", "struct", None), (3, 3, "greet§", "function", None), (5, 5, "new", "function", None), (7, 7, "f", "function", "inner§"), (8, 8, "T", "interface", None)]),
    ("java", "package a;\npublic class Calc§<T> extends Base {\n  static { init(); }\n  public Calc§(int a) { this.a = a; }\n  @Override\n  public Map<String, List<T>> add(int a,\n      int b) throws X { return a + b; }\n  enum E { A }\n}\n", [(4, 4, "Calc§", "method", "Calc§"), (5, 7, "add", "method", "Calc§"), (8, 8, "E", "enum", "Calc§")]),
    ("cs", "namespace A.B§ {\n  public class Foo§ : Bar {\n    public int X { get; set; }\n    public async Task<int> Run(string s) { return 1; }\n  }\n  public interface I { void M(); }\n}\n", [(3, 3, "X", "field", "Foo§"), (4, 4, "Run", "method", "Foo§"), (6, 6, "I", "interface", "A.B§")]),
    ("cpp", '#include "base.hpp"\nnamespace app§ {\nclass Engine§ : public Base {\npublic:\n  int run(int x) { return x; }\n};\nusing Alias = int;\n}\nint app::Engine::go§(int a) const { return 1; }\n', [(5, 5, "run", "function", "Engine§"), (7, 7, "Alias", "type", "app§"), (9, 9, "app::Engine::go§", "function", None)]),
    ("kt", "class A§(val x: Int) : B() {\n  fun go(a: Int): Int {\n    return a\n  }\n  fun one§() = 1\n}\nfun top() { }\n", [(2, 4, "go", "function", "A§"), (5, 5, "one§", "function", "A§"), (7, 7, "top", "function", None)]),
    ("py", "import os\n\n@deco\ndef f§(x):\n    return x\n\nclass A§(B):\n    def m(self):\n        pass\n", [(3, 5, "f§", "function", None), (7, 7, "A§", "class", None), (8, 9, "m", "function", "A§")]),
]
_QUOTED = lambda x: "NULL" if x is None else f"replace('{x}', '§', CAST(p_partkey AS VARCHAR))" if isinstance(x, str) else str(x)
_ROWS = " UNION ALL ".join(
    f"SELECT 'src/f' || p_partkey || '.{ending}' AS path, {first} AS start_line, {last} AS end_line, {_QUOTED(name)} AS symbol, '{kind}' AS kind, {_QUOTED(parent)} AS parent FROM part WHERE p_partkey % {len(SOURCES)} = {n}"
    for n, (ending, _, found) in enumerate(SOURCES) for first, last, name, kind, parent in found
)


@query(f"SELECT * FROM ({_ROWS})")
def symbol_chunks(spark, sf_dir):
    number = (F.col("p_partkey") % len(SOURCES) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), number)
    key = F.col("p_partkey").cast("string")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), key, F.lit("."), pick([s[0] for s in SOURCES])).alias("path"), F.replace(pick([s[1] for s in SOURCES]), F.lit("§"), key).alias("contents"))
    return symbols.chunk_symbols(files).select("path", "start_line", "end_line", "symbol", "kind", "parent")
