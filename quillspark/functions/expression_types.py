"""Types of what a source leaves without an annotation: initializers and returned values.

An expression's type is told from literals, operators, the file's own functions, classes and variables, and some members
of the language's own values. What isn't told by these is ``any``: other files, parameters without annotation, and
branches of different types. Names are taken from the whole file, as functions and classes may be used before they stand.
"""

from __future__ import annotations

import re

# Members of strings, numbers and arrays, and of the language's own objects, by the type they give.
STRING = {"length": "number", **dict.fromkeys("at charAt concat normalize padEnd padStart repeat replace replaceAll slice substr substring toLowerCase toString toUpperCase trim trimEnd trimStart".split(), "string"), **dict.fromkeys("charCodeAt indexOf lastIndexOf localeCompare search".split(), "number"), **dict.fromkeys("endsWith includes startsWith".split(), "boolean"), "split": "string[]"}
NUMBER = dict.fromkeys("toExponential toFixed toLocaleString toPrecision toString".split(), "string")
ARRAY = {"length": "number", "join": "string", **dict.fromkeys("indexOf lastIndexOf push unshift findIndex".split(), "number"), **dict.fromkeys("every includes some".split(), "boolean")}
SAME_ARRAY = frozenset("concat fill filter reverse slice sort splice".split())
GLOBAL = {"JSON.stringify": "string", "Date.now": "number", "Object.keys": "string[]", "Array.isArray": "boolean", "Number.isInteger": "boolean", "Number.isNaN": "boolean", "Number.parseInt": "number", "Number.parseFloat": "number", "String.fromCharCode": "string"}
CALLED = {"String": "string", "Number": "number", "parseInt": "number", "parseFloat": "number", "Boolean": "boolean", "isNaN": "boolean", "isFinite": "boolean", "encodeURIComponent": "string", "decodeURIComponent": "string"}
_COMPARE = {"===", "!==", "==", "!=", "<", ">", "<=", ">=", "instanceof", "in"}
_WORDS = {"return", "typeof", "await", "new", "in", "of", "instanceof", "as", "case", "void", "delete", "yield", "else", "satisfies"}


def widened(kind: str) -> str:
    """A literal's type as that of its kind."""
    if kind[:1] == '"':
        return "string"
    if kind in ("true", "false"):
        return "boolean"
    return "number" if re.fullmatch(r"\d[\w.]*", kind) else kind


def same(kinds: list[str]) -> str:
    """The one type of all, else any."""
    wide = {widened(k) for k in kinds}
    return wide.pop() if len(wide) == 1 else "any"


def returned(kind: str) -> str:
    """What calling a value of a function's type gives."""
    depth = 0
    for k, c in enumerate(kind):
        depth += (c in "([{") - (c in ")]}")
        if c == ")" and depth == 0:
            return kind[k + 5 :] if kind.startswith(" => ", k + 1) else "any"
    return "any"


class Types:
    """Expressions over the tokens of a reader. ``rows`` are its declarations, whose types are looked up by name."""

    def __init__(self, reader):
        self.r, self.t = reader, reader.tokens
        self.look()

    def look(self) -> None:
        rows = self.r.out
        own = {d["ord"]: d["name"] for d in rows if d["kind"] == "class"}
        self.functions = {d["name"]: d["type"] for d in rows if d["kind"] == "function" and d["name"]}
        self.values = {d["name"]: d["type"] for d in rows if d["kind"] == "variable"}
        self.members = {(own.get(d["parent"]), d["name"]): d["type"] for d in rows if d["kind"] == "property"}
        self.methods = {(own.get(d["parent"]), d["name"]): d["type"] for d in rows if d["kind"] == "method"}
        # parameters of a constructor that are properties as well
        for d in rows:
            if d["kind"] == "constructor":
                for m in re.finditer(r"(?:^|, )(?:(?:public|private|protected|readonly) )+(\w+)\??: ((?:[^,()<>{}]|\([^)]*\)|<[^>]*>|\{[^}]*\})+)", d["params"] or ""):
                    self.members.setdefault((own.get(d["parent"]), m[1]), m[2])

    # places

    def level(self, a: int, b: int) -> list[int]:
        """Tokens from ``a`` to before ``b`` outside brackets; type arguments of a call are passed over."""
        out, k = [], a
        while k < b:
            t = self.t[k]
            out.append(k)
            if t.kind == "sign" and t.text in "([{":
                k = self.r.closing(k)
            elif t.text == "<" and k > a and self.t[k - 1].kind == "word" and self.t[k - 1].end == t.start:
                end = self.r.angle(k)
                if end + 1 < b and self.t[end + 1].text == "(":
                    out.pop()
                    k = end
            k += 1
        return out

    def binary(self, k: int, a: int) -> bool:
        """Whether the sign at ``k`` stands between two values."""
        before = self.t[k - 1]
        return k > a and (before.kind in ("number", "string", "tick", "regex") or before.kind == "word" and before.text not in _WORDS or before.text in (")", "]", "}"))

    def cut(self, at: list[int], a: int, b: int) -> list[tuple[int, int]]:
        return list(zip([a, *(k + 1 for k in at)], [*at, b]))

    # expressions

    def of(self, a: int, b: int, scope: dict[str, str], cls: str | None, constant: bool = False, depth: int = 0) -> str:
        """The type of the expression from token ``a`` to before ``b``."""
        if a >= b or depth > 40:
            return "any"
        inner = lambda x, y: self.of(x, y, scope, cls, depth=depth + 1)
        level = self.level(a, b)
        find = lambda *texts: [k for k in level if self.t[k].text in texts and self.t[k].kind in ("sign", "word")]
        if arrow := find("=>"):
            return self.arrow(a, arrow[0], b, scope, cls, depth)
        if self.t[a].text in ("function", "class", "async", "yield", "...", "{") and self.t[a].text != "{":
            return "any"
        if (ask := find("?")) and (colon := [k for k in find(":") if k > ask[0]]):
            return same([inner(ask[0] + 1, colon[-1]), inner(colon[-1] + 1, b)])
        for signs in (("??", "||"), ("&&",)):
            if at := find(*signs):
                return same([inner(x, y) for x, y in self.cut(at, a, b)])
        if (cast := [k for k in find("as", "satisfies") if k > a]) and cast[-1] + 1 < b:
            kind = self.r.slice(cast[-1] + 1, b - 1)
            return inner(a, cast[-1]) if kind == "const" or self.t[cast[-1]].text == "satisfies" else kind
        if any(k > a for k in find(*_COMPARE)):
            return "boolean"
        sums = [k for k in find("+", "-") if self.binary(k, a)]
        if sums:
            if all(self.t[k].text == "-" for k in sums):
                return "number"
            kinds = [widened(inner(x, y)) for x, y in self.cut(sums, a, b)]
            return "string" if "string" in kinds else same(kinds) if set(kinds) == {"number"} else "any"
        if any(self.binary(k, a) for k in find("*", "/", "%", "&", "|", "^")):
            return "number"
        first = self.t[a].text
        if first == "!":
            return "boolean"
        if first in ("-", "+", "~"):
            literal = b - a == 2 and constant and self.t[a + 1].kind == "number" and first == "-"
            return first + self.t[a + 1].text if literal else "number"
        if first == "typeof":
            return "string"
        if first == "await":
            kind = inner(a + 1, b)
            return kind[8:-1] if kind.startswith("Promise<") else kind
        return self.chain(a, b, scope, cls, constant, depth)

    def arrow(self, a: int, arrow: int, b: int, scope: dict[str, str], cls: str | None, depth: int) -> str:
        is_async = self.t[a].text == "async"
        a += is_async
        known, params, result = dict(scope), "", None
        if self.t[a].text == "(":
            close = self.r.closing(a)
            params = self.r.params(a, close)
            known |= self.scope(params)
            if close + 1 < arrow and self.t[close + 1].text == ":":
                result = self.r.slice(close + 2, arrow - 1)
        elif arrow - a == 1:
            params = f"{self.t[a].text}: any"
            known[self.t[a].text] = "any"
        else:
            return "any"
        if result is None:
            if arrow + 1 < b and self.t[arrow + 1].text == "{":
                result = self.body(arrow + 1, self.r.closing(arrow + 1), known, cls, depth)
            else:
                result = widened(self.of(arrow + 1, b, known, cls, depth=depth + 1))
            result = f"Promise<{result}>" if is_async and not result.startswith("Promise<") else result
        return f"({params}) => {result}"

    @staticmethod
    def scope(params: str) -> dict[str, str]:
        """Names and types of shown parameters; patterns and what lies deeper are left out."""
        out, depth, begin = {}, 0, 0
        for k, c in enumerate(params + ","):
            depth += (c in "([{<") - (c in ")]}" or c == ">" and params[k - 1 : k] != "=")
            if c == "," and depth <= 0:
                m = re.match(r"\s*(?:(?:public|private|protected|readonly|override) )*([\w$]+)\??: ([\s\S]+)", params[begin:k])
                if m:
                    out[m[1]] = m[2]
                begin = k + 1
        return out

    def body(self, open_: int, close: int, scope: dict[str, str], cls: str | None, depth: int = 0) -> str:
        """What a function's body returns: void without a value, one type if all values have it, else any."""
        known, kinds, empty = dict(scope), [], False
        k = open_ + 1
        while k < close:
            t = self.t[k]
            if t.text == "function" or t.text == "=>" and self.t[k + 1].text == "{" or t.text == "class":
                while k < close and self.t[k].text != "{":  # other functions' returns aren't these
                    k = self.r.closing(k) + 1 if self.t[k].text in ("(", "[") else k + 1
                k = self.r.closing(k)
            elif t.kind == "sign" and t.text == "{" and self.t[k - 1].text == ")" and k >= 2 and self.method_before(k):
                k = self.r.closing(k)
            elif t.text in ("const", "let", "var") and self.t[k - 1].text != ".":
                end = self.r.end_of_statement(k, close)
                for x, y in self.r.split(k + 1, end + (self.t[end].text != ";")):
                    equals = self.r.equals(x, y)
                    if self.t[x].kind == "word" and x + 1 < y and self.t[x + 1].text == ":":
                        known[self.t[x].text] = self.r.slice(x + 2, equals - 1)
                    elif self.t[x].kind == "word" and equals < y:
                        known[self.t[x].text] = widened(self.of(equals + 1, y, known, cls, depth=depth + 1))
            elif t.text == "return" and self.t[k - 1].text != ".":
                if self.t[k + 1].text in (";", "}") or self.r.new_line(k + 1):
                    empty = True
                else:
                    end = self.r.end_of_statement(k + 1, close)
                    kinds.append(widened(self.of(k + 1, end + (self.t[end].text != ";"), known, cls, depth=depth + 1)))
            k += 1
        if not kinds:
            return "void"
        return "any" if empty else same(kinds)

    def method_before(self, k: int) -> bool:
        """Whether the block at ``k`` is a method's in an object: a name and brackets before it, and a comma or brace before the name."""
        depth, j = 0, k - 1
        while j > 0:
            depth += (self.t[j].text == ")") - (self.t[j].text == "(")
            if depth == 0:
                break
            j -= 1
        return j >= 2 and self.t[j - 1].kind == "word" and self.t[j - 2].text in ("{", ",") and self.t[j - 1].text not in ("if", "for", "while", "switch", "catch", "with")

    def chain(self, a: int, b: int, scope: dict[str, str], cls: str | None, constant: bool, depth: int) -> str:
        """A value and the members, calls and places that follow it."""
        t, k = self.t[a], a + 1
        one = b - a == 1
        if t.kind == "string":
            kind = '"' + t.text[1:-1] + '"' if constant and one else "string"
        elif t.kind == "number":
            kind = t.text if constant and one else "number"
        elif t.text in ("true", "false"):
            kind = t.text if constant and one else "boolean"
        elif t.kind == "tick":
            kind = "string"
        elif t.kind == "regex":
            kind = "RegExp"
        elif t.text == "new":
            while k + 1 < b and self.t[k + 1].text == ".":
                k += 2
            last = k
            if k + 1 < b and self.t[k + 1].text == "<":
                last = self.r.angle(k + 1)
            kind, k = self.r.slice(a + 1, last), last + 1
            if k < b and self.t[k].text == "(":
                k = self.r.closing(k) + 1
        elif t.text == "(":
            close = self.r.closing(a)
            kind, k = self.of(a + 1, close, scope, cls, depth=depth + 1), close + 1
        elif t.text == "[":
            close = self.r.closing(a)
            kinds = [self.of(x, y, scope, cls, depth=depth + 1) for x, y in self.r.split(a + 1, close)]
            item = same(kinds) if kinds else "any"
            kind, k = (f"({item})[]" if "=>" in item or " | " in item else f"{item}[]"), close + 1
        elif t.text == "{":
            close = self.r.closing(a)
            kind, k = self.object(a, close, scope, cls, depth), close + 1
        elif t.text == "this":
            kind = "this" if one and cls else cls or "any"
        elif t.kind == "word":
            path = t.text
            while k + 1 < b and self.t[k].text == "." and f"{path}.{self.t[k + 1].text}" in GLOBAL and path not in scope:
                path, k = f"{path}.{self.t[k + 1].text}", k + 2
            if k < b and self.t[k].text == "<" and (end := self.r.angle(k)) + 1 < b and self.t[end + 1].text == "(":
                k = end + 1
            called = k < b and self.t[k].text == "("
            if t.text in scope:
                kind = scope[t.text]
            elif path in GLOBAL and called:
                return self.follow(GLOBAL[path], self.r.closing(k) + 1, b)
            elif t.text == "Math" and k + 1 < b and self.t[k].text == ".":
                k += 2
                return self.follow("number", self.r.closing(k) + 1 if k < b and self.t[k].text == "(" else k, b)
            elif called and t.text in self.functions:
                return self.follow(self.functions[t.text], self.r.closing(k) + 1, b)
            elif called and t.text in CALLED:
                return self.follow(CALLED[t.text], self.r.closing(k) + 1, b)
            else:
                kind = self.values.get(t.text, "any")
        else:
            return "any"
        return self.follow(kind, k, b)

    def object(self, a: int, close: int, scope: dict[str, str], cls: str | None, depth: int) -> str:
        fields = []
        for x, y in self.r.split(a + 1, close):
            if self.t[x].kind not in ("word", "string") or self.t[x].text in ("get", "set", "async") and y - x > 1 and self.t[x + 1].text != ":":
                return "any"
            if y - x == 1 and self.t[x].kind == "word":
                kind = widened(scope.get(self.t[x].text) or self.values.get(self.t[x].text, "any"))
            elif y - x > 2 and self.t[x + 1].text == ":":
                kind = widened(self.of(x + 2, y, scope, cls, depth=depth + 1))
            else:
                return "any"
            fields.append(f"{self.t[x].text}: {kind};")
        return "{ " + " ".join(fields) + " }" if fields else "{}"

    def follow(self, kind: str, k: int, b: int) -> str:
        while k < b:
            t, kind = self.t[k], widened(kind)
            if t.text == "!":
                k += 1
            elif t.text in (".", "?.") and k + 1 < b and self.t[k + 1].kind == "word":
                if t.text == "?.":
                    return "any"
                name, k = self.t[k + 1].text, k + 2
                if k < b and self.t[k].text == "<":
                    k = self.r.angle(k) + 1
                called = k < b and self.t[k].text == "("
                base = kind.split("<")[0]
                if called and (base, name) in self.methods:
                    kind = self.methods[base, name]
                elif (base, name) in self.members:
                    kind = returned(self.members[base, name]) if called else self.members[base, name]
                elif kind.endswith("[]"):
                    kind = kind if called and name in SAME_ARRAY else ARRAY.get(name, "any")
                else:
                    kind = {"string": STRING, "number": NUMBER}.get(kind, {}).get(name, "any")
                if called:
                    k = self.r.closing(k) + 1
            elif t.text == "(":
                kind, k = returned(kind), self.r.closing(k) + 1
            elif t.text == "[":
                kind, k = (kind[:-2].removeprefix("(").removesuffix(")") if kind.endswith("[]") else "any"), self.r.closing(k) + 1
            else:
                return "any"
        return kind


def settle(reader, pending: list[dict]) -> None:
    """Give the ``pending`` declarations of a reader their types, in rounds, as one may need another's."""
    types = Types(reader)
    for _ in range(4):
        moved = False
        for p in pending:
            row = reader.out[p["ord"]]
            cls = reader.out[row["parent"]]["name"] if row["parent"] >= 0 else None
            if "body" in p:
                kind = types.body(*p["body"], types.scope(row["params"]), cls)
                kind = f"Promise<{kind}>" if p["async"] and not kind.startswith("Promise<") else kind
            else:
                kind = types.of(*p["init"], {}, cls, p["constant"])
                kind = kind if p["constant"] else widened(kind)
            if kind != row["type"]:
                row["type"], moved = kind, True
        if not moved:
            break
        types.look()
