from __future__ import annotations

import pytest

from quillspark.operators import structure

FILES = "scan_index bigint, path string, content string"


def skeleton(spark, source, name="t.ts", mapped=False):
    return structure.skeletons(spark.createDataFrame([(0, f"/r/{name}", source)], FILES), mapped).first()["skeleton"]


CLASS = """/** Adds things. */
export class Calc<T> extends Base implements A, B<T> {
  private total: number = 0;
  name = 'x';
  /**
   * Adds.
   */
  add(a: number, b?: number, ...more: number[]): number {
    return this.total + a;
  }
  constructor(private readonly start: number, step = 1) { super(); this.total = start; }
  get value(): number { return this.total; }
  static async load(id: string): Promise<Calc> { return new Calc(1); }
}"""


def test_class(spark):
    assert skeleton(spark, CLASS) == "\n".join([
        "/* Skeleton of t.ts */", "", "/** Adds things. */", "export class Calc<T> extends Base implements A, B<T> {", "  private total: number;", "  name: string;", "",
        "  /**", "     * Adds.", "     */", "  add(a: number, b?: number, more?: number[]): number {", "    /* trimmed */", "  }", "",
        "  static async load(id: string): Promise<Calc> {", "    /* trimmed */", "  }", "",
        "  constructor(private readonly start: number, step?: number) {", "    /* trimmed */", "  }", "", "}",
    ])


@pytest.mark.parametrize(
    "source, held, gone",
    [
        ("export interface User {\n  id: string;\n  name: string;\n}", ["export interface User {\n  id: string;\n  name: string;\n}"], []),
        ("import { A } from './a';\nimport * as b from 'b';\nexport function go(): void { console.log(1); }", ["import { A } from './a';", "import * as b from 'b';", "export function go(): void {", "/* trimmed */"], ["console"]),
        ("export type S = 'a' | 'b';\ntype Id = string;", ["export type S = 'a' | 'b';", "type Id = string;"], []),
        ("/**\n * Sums.\n */\nexport function sum(xs: number[]): number {\n  return xs.reduce((a, b) => a + b, 0);\n}", ["* Sums.", "export function sum(xs: number[]): number {", "/* trimmed */"], ["reduce"]),
        ("const x = {", ["/* Skeleton of t.ts */"], []),
        ("class A { m( {", ["class A {"], []),
        ("export enum E { A = 1, B }\nexport default E;\nexport { x as y } from './x';", ["export enum E { A = 1, B }", "export default E;", "export { x as y } from './x';"], []),
        ("export const a = 5, b: string = 'x', f = (q: number): string => 'y';\nlet o = { z: 1 };\nvar n;", ["export const a: 5 = 5;", "export const b: string = 'x';", "export const f: (q: number) => string = /* trimmed */;", "let o: { z: number; } = /* trimmed */;", "var n: any;"], []),
        ("function f(a, { b, c }: { b: number; c: string }, d: (x: number) => void = () => {}) { return a; }", ["function f(a: any, { b, c }: { b: number; c: string }, d?: (x: number) => void): any {"], []),
        ("export default function () {}", ["export default function undefined(): void {"], []),
        ("if (a < b) { function inner() {} }\nfoo();\n@dec({ x: 1 })\nclass D { @p() q: number; static { boot(); } [k: string]: any; }", ["class D {\n  q: number;"], ["inner", "foo", "boot", "dec"]),
        ("const s = `a${`b${1}`}`; const r = /[/]{/g;\nexport function z(): string { return '}'; }", ["export function z(): string {"], ["return"]),
        ("type A =\n  | 'x'\n  | 'y'\nexport function k(): Promise<Map<string, number>> { return q }", ["type A =\n  | 'x'\n  | 'y'", "export function k(): Promise<Map<string, number>> {"], []),
        ("declare function ext(a: string): void;\nfunction over(a: string): void;\nfunction over(a: any): void { go(); }", ["declare function ext(a: string): void {", "function over(a: any): void {"], ["over(a: string)"]),
        ("namespace N { export function hid() {} }\nabstract class Q { abstract go(): void; protected readonly z = 3 }", ["abstract class Q {\n  protected readonly z: 3;", "  abstract go(): void {"], ["hid"]),
    ],
)
def test_shapes(spark, source, held, gone):
    text = skeleton(spark, source)
    assert all(x in text for x in held), text
    assert not any(x in text for x in gone), text


def test_kinds_come_in_order(spark):
    text = skeleton(spark, "export const v = 1;\nfunction f() {}\nenum E { A }\ntype T = 1;\ninterface I {}\nclass C {}\nimport 'x';\n")
    places = [text.index(x) for x in ("import", "class C", "interface I", "type T", "enum E", "function f", "const v")]
    assert places == sorted(places)


def test_mapping(spark):
    text = skeleton(spark, CLASS + "\nfunction f(a: string) {}\nexport const g = (x: number) => x, h = [1].map(y => y);", mapped=True)
    assert text.startswith("/* Skeleton of t.ts - Generated with symbol mapping */\n\nexport class")
    for mark in ("/* [SYMBOL:Calc.add] - Implementation available via get_symbol_details */", "[SYMBOL:Calc.constructor]", "[SYMBOL:f]", "export const g: (x: number) => number = /* [SYMBOL:g] */;", "[SYMBOL:h] */;"):
        assert mark in text, text
    assert "Adds" not in text


def corpus(spark):
    return spark.createDataFrame([(0, "/r/a.ts", CLASS + "\nexport const g = (x: number) => x;\n"), (1, "/r/b.ts", "function g() {\n  return 1;\n}\nfunction other(o: { k: number }) {}\n")], FILES)


def test_symbols(spark):
    table = structure.symbols(structure.parsed(corpus(spark)), "/r")
    rows = [(r["symbol_id"], r["symbol_type"], r["file_path"], r["start_line"], r["end_line"], r["parent_class"], r["signature"]) for r in table.orderBy("file_order", "symbol_order").collect()]
    assert rows == [
        ("Calc.add", "method", "a.ts", 8, 10, "Calc", "add(a: number, b?: number, ...more: number[]): number"),
        ("Calc.load", "method", "a.ts", 13, 13, "Calc", "static async load(id: string): Promise<Calc>"),
        ("Calc.constructor", "constructor", "a.ts", 11, 11, "Calc", None),
        ("g", "arrow-function", "a.ts", 15, 15, None, "const g: (x: number) => number"),
        ("g", "function", "b.ts", 1, 3, None, "function g()"),
        ("other", "function", "b.ts", 4, 4, None, "function other(o:"),
    ]
    found = structure.symbol_details(table, corpus(spark), "g", "/r").collect()
    assert [(r["file_path"], r["content"]) for r in found] == [("a.ts", "export const g = (x: number) => x;")]
    assert structure.symbol_details(table, corpus(spark), "none", "/r").collect() == []
    assert structure.search(table, "CALC").count() == 1  # in a signature
    assert structure.search(table, "").count() == 6 and structure.search(table, "g", "function").count() == 1
    assert {r["symbol_type"]: r["n"] for r in structure.stats(table).collect()} == {"method": 2, "constructor": 1, "arrow-function": 1, "function": 2}
    assert tuple(structure.totals(table).first()) == (2, 6)


def test_positions(spark):
    row = structure.symbols(structure.parsed(corpus(spark))).where("symbol_id = 'other'").first()
    source = corpus(spark).where("scan_index = 1").first()["content"]
    assert source[row["start_pos"] : row["end_pos"]] == "function other(o: { k: number }) {}"


def test_metadata(spark):
    source = "import a from 'a';\nimport './b'\nexport { p, q as r };\nexport function f() {}\nexport default class {}\nexport const x = 1, y = 2;\nclass H {}\ninterface I {}\nexport type T = 1;\nenum E {}\n"
    r = structure.file_metadata(spark.createDataFrame([(0, "a.ts", source), (1, "b.ts", ""), (2, "c.ts", None)], FILES)).orderBy("scan_index").collect()
    assert (r[0]["imports"], r[0]["exports"], r[0]["symbol_count"], r[0]["lines_of_code"]) == (["a", "./b"], ["p", "q", "f", "anonymous", "x", "y"], 6, 11)
    assert r[1]["exports"] is None and r[2]["symbol_count"] is None


def test_parser_sits_above_the_limit(spark):
    """Only the best files are parsed, and the scores are no full sort."""
    from quillspark.operators import scoring
    from quillspark.plans.analysis import analyses

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS scan_index", "source AS path", "text AS content")
    plan = analyses(scoring.rank_basic(docs, "calc", 1), docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("TakeOrderedAndProject") < plan.index("FileScan")
