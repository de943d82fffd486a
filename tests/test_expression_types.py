"""Types of members, functions and variables that have no annotation."""

from __future__ import annotations

import pytest

from quillspark.functions.declarations import read

CLASS = """
export class Cart extends Base {
  private total = 0; readonly tag = 'c'; static names = ['a', 'b']; items = new Map<string, number>(); open = !this.total;
  constructor(private readonly key: string, limit = 3) { super(); }
  count() { return this.total + 1; }
  label() { const l = this.tag; return l + this.count(); }
  self() { return this; }
  id() { return this.key; }
  item() { return this.items.get('a'); }
  nested() { const q = () => { return 'inner'; }; return { m() { return 's'; } } ? 4 : 5; }
  async go() { return this.count(); }
  made() { return new Cart('a').label(); }
  listed() { return [this.label()]; }
  cast(v: unknown) { return v as Foo<Bar>; }
  mixed(v: boolean) { if (v) return 1; return 'a'; }
  empty(v: boolean) { if (v) return; go(); }
  get size() { return 1; }
  *each() { return 1; }
}
"""


def types(source: str, *kinds: str) -> dict[str, str]:
    return {d["name"]: d["type"] for d in read(source) if d["kind"] in kinds}


def test_members_of_a_class():
    assert types(CLASS, "property") == {"total": "number", "tag": '"c"', "names": "string[]", "items": "Map<string, number>", "open": "boolean"}
    want = {"count": "number", "label": "string", "self": "this", "id": "string", "item": "any", "nested": "number", "go": "Promise<number>", "made": "string", "listed": "string[]", "cast": "Foo<Bar>", "mixed": "any", "empty": "void", "each": "any"}
    assert types(CLASS, "method") == want


@pytest.mark.parametrize(
    ("expression", "constant", "let"),
    [
        ("5", "5", "number"),
        ("-3", "-3", "number"),
        ("'a'", '"a"', "string"),
        ("true", "true", "boolean"),
        ("`t${later(1)}`", "string", "string"),
        ("/x/g", "RegExp", "RegExp"),
        ("1 + 2 * 3", "number", "number"),
        ("'a' + 1", "string", "string"),
        ("given + 1", "any", "any"),
        ("given > 1 && given < 3", "boolean", "boolean"),
        ("typeof given", "string", "string"),
        ("[1, 2]", "number[]", "number[]"),
        ("[]", "any[]", "any[]"),
        ("[1, 'a']", "any[]", "any[]"),
        ("{ a: 1, 'b-c': 'x', d: { e: true } }", "{ a: number; 'b-c': string; d: { e: boolean; }; }", "{ a: number; 'b-c': string; d: { e: boolean; }; }"),
        ("{ a, ...b }", "any", "any"),
        ("{}", "{}", "{}"),
        ("later(1)", "number", "number"),
        ("later<string>(1).toFixed(2).length", "number", "number"),
        ("'a,b'.split(',')[0].trim()", "string", "string"),
        ("[3, 1].sort()[0]", "number", "number"),
        ("new Thing<string>('x')", "Thing<string>", "Thing<string>"),
        ("new a.b.Thing()", "a.b.Thing", "a.b.Thing"),
        ("new Thing('x').size", "number", "number"),
        ("new Thing('x').unknown", "any", "any"),
        ("Math.max(1, 2)", "number", "number"),
        ("JSON.stringify({}).length", "number", "number"),
        ("given ? 'a' : 'b'", "string", "string"),
        ("given ? 'a' : 1", "any", "any"),
        ("x as unknown as Other", "Other", "Other"),
        ("(q: number) => q * 2", "(q: number) => number", "(q: number) => number"),
        ("async (q: string) => { return q === 'x'; }", "(q: string) => Promise<boolean>", "(q: string) => Promise<boolean>"),
        ("q => q", "(q: any) => any", "(q: any) => any"),
        ("(q: string): Out => make(q)", "(q: string) => Out", "(q: string) => Out"),
        ("double(3)", "number", "number"),
        ("imported(3)", "any", "any"),
        ("given?.length", "any", "any"),
    ],
)
def test_initializers(expression, constant, let):
    rest = "function later(n: number) { return n + 1; }\nconst double = (n: number) => n * 2;\nclass Thing<T> { size = 1; }\n"
    found = types(f"const c = {expression};\nlet l = {expression};\n{rest}", "variable")
    assert (found["c"], found["l"]) == (constant, let)


def test_one_needs_another_whatever_their_order():
    source = "const d = c + 1; const c = b(); function b() { return a().length; } function a() { return 'x'; }"
    assert types(source, "variable", "function") == {"d": "number", "c": "number", "b": "number", "a": "string"}


def test_functions_that_call_themselves_end():
    assert types("function f(n: number) { return n ? f(n - 1) : 1; }\nfunction g() { return h(); }\nfunction h() { return g(); }", "function") == {"f": "any", "g": "any", "h": "any"}


@pytest.mark.parametrize("source", ["const a = ", "let x = (((", "function f() { return ", "class C { m() { return this.", "const a = b ? c", "const q = {", "const a = " + "(" * 3000, "const a = 1" + " + 1" * 5000 + ";", "const a = " + "[" * 500 + "]" * 500])
def test_broken_and_very_deep_sources(source):
    assert isinstance(read(source), list)
