"""The declarations of a TypeScript source, one flat list a file.

``declarations`` is the only Python in the skeleton operators: it finds where declarations begin and end and what
their heads say. What is made of them (metadata, skeletons, symbols) is Column expressions over the list.

Types are the annotations as written. Where there is none, ``expression_types`` works them out of initializers and
returned values, as far as the file itself tells them; all else is any.
Positions are code points from 0, lines count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.expression_types import settle

FIELDS = [
    ("ord", T.IntegerType()),
    ("parent", T.IntegerType()),  # the class of a member, else -1
    ("kind", T.StringType()),  # import class property method constructor interface type enum function variable export assignment
    ("name", T.StringType()),
    ("modifiers", T.StringType()),
    ("head", T.StringType()),  # class: type parameters, extends, implements; variable: const, let or var
    ("params", T.StringType()),
    ("type", T.StringType()),
    ("init", T.StringType()),
    ("doc", T.StringType()),
    ("text", T.StringType()),
    ("names", T.ArrayType(T.StringType())),  # exported names, or the module of an import
    ("statement", T.IntegerType()),  # declarations of one statement share it
    ("start_pos", T.IntegerType()),
    ("end_pos", T.IntegerType()),
    ("start_line", T.IntegerType()),
    ("end_line", T.IntegerType()),
]
DECLARATIONS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in FIELDS]))
PARSED = T.StructType([T.StructField("items", DECLARATIONS), T.StructField("error", T.StringType())])

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<doc>/\*\*(?!/)[\s\S]*?(?:\*/|\Z))|(?P<note>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)
    |(?P<string>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<word>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)
    |(?P<number>\d[\w.]*)|(?P<tick>`)|(?P<sign>=>|\.\.\.|\?\.|[=!]==?|&&|\|\||\?\?|[<>]=|[-+*/%&|^]=|[\s\S])""",
    re.X,
)
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "override", "readonly", "accessor"}
_GOES_ON = re.compile(r"[=|&?:,+\-*/%<.(\[]|=>|&&|\|\||\?\?|extends|keyof|typeof|new|in|of|as|is|satisfies|instanceof|await")
_COMES_ON = re.compile(r"[=|&?:,+\-*/%<>.()\[\]]|=>|&&|\|\||\?\?|\?\.|as|satisfies|instanceof|in")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")


class _Token:
    __slots__ = ("kind", "text", "start", "end")

    def __init__(self, kind: str, text: str, start: int):
        self.kind, self.text, self.start, self.end = kind, text, start, start + len(text)


def _template_end(source: str, at: int) -> int:
    """The place behind the template that begins at ``at``."""
    at += 1
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(source) and depth:
                if source[at] == "`":
                    at = _template_end(source, at)
                    continue
                depth += {"{": 1, "}": -1}.get(source[at], 0)
                at += 1
        else:
            at += 1
    return at


def _tokens(source: str) -> list[_Token]:
    out: list[_Token] = []
    at = 0
    while at < len(source):
        m = _LEX.match(source, at)
        kind, text = m.lastgroup, m[0]
        if kind == "tick":
            text = source[at : _template_end(source, at)]
        elif text in ("/", "/=") and (not out or out[-1].kind == "sign" and out[-1].text not in (")", "]", "}") or out[-1].text in ("return", "typeof", "case")):
            if r := _REGEX.match(source, at):
                kind, text = "regex", r[0]
        if kind not in ("space", "note"):
            out.append(_Token(kind, text, at))
        at += len(text)
    return out


class _Reader:
    def __init__(self, source: str):
        self.source, self.tokens, self.i = source, _tokens(source), 0
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.out: list[dict] = []
        self.pending: list[dict] = []  # declarations without an annotation, and where their values stand
        self.statement = 0

    # places in the list of tokens

    def text(self, k: int = 0) -> str:
        return self.tokens[self.i + k].text if self.i + k < len(self.tokens) else ""

    def new_line(self, k: int) -> bool:
        return k > 0 and k < len(self.tokens) and "\n" in self.source[self.tokens[k - 1].end : self.tokens[k].start]

    def closing(self, k: int) -> int:
        """The token that closes the bracket at ``k``, or the last one."""
        depth = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "sign":
                depth += (t.text in _OPENS) - (t.text in _CLOSES)
                if depth == 0:
                    return k
            k += 1
        return len(self.tokens) - 1

    def angle(self, k: int) -> int:
        """The ``>`` that closes the ``<`` at ``k``."""
        depth = 0
        while k < len(self.tokens):
            t = self.tokens[k].text
            if t in _OPENS and self.tokens[k].kind == "sign":
                k = self.closing(k)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return k
            k += 1
        return len(self.tokens) - 1

    def end_of_statement(self, k: int, stop: int | None = None) -> int:
        """The last token of the statement at ``k``, its semicolon included."""
        stop = len(self.tokens) if stop is None else stop
        first = k
        while k < stop:
            t = self.tokens[k]
            if t.text == ";" and t.kind == "sign":
                return k
            if k > first and self.new_line(k) and not _GOES_ON.fullmatch(self.tokens[k - 1].text) and not _COMES_ON.fullmatch(t.text):
                return k - 1
            if t.kind == "sign" and t.text in _OPENS:
                k = min(self.closing(k), stop - 1)
            k += 1
        return stop - 1

    def slice(self, a: int, b: int) -> str:
        """The source from token ``a`` to token ``b``."""
        return self.source[self.tokens[a].start : self.tokens[b].end] if a <= b < len(self.tokens) else ""

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges of tokens between the commas from ``a`` to before ``b``."""
        out, begin, k = [], a, a
        angles = 0
        while k < b:
            t = self.tokens[k]
            if t.kind == "sign":
                if t.text in _OPENS:
                    k = self.closing(k)
                elif t.text == "<" and (self.tokens[k - 1].kind == "word"):
                    angles += 1
                elif t.text == ">" and angles:
                    angles -= 1
                elif t.text == "," and not angles:
                    out.append((begin, k))
                    begin = k + 1
            k += 1
        return [*out, (begin, b)] if begin < b else out

    def line(self, pos: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, pos) + 1

    # what is found

    def add(self, kind: str, a: int, b: int, **more) -> int:
        b = min(b, len(self.tokens) - 1)
        row = {n: None for n, _ in FIELDS} | {"ord": len(self.out), "parent": -1, "kind": kind, "modifiers": "", "text": self.slice(a, b), "names": [], "statement": self.statement}
        row |= {"start_pos": self.tokens[a].start, "end_pos": self.tokens[b].end, "start_line": self.line(self.tokens[a].start), "end_line": self.line(self.tokens[b].end)}
        self.out.append(row | more)
        return row["ord"]

    def lead(self) -> tuple[str | None, int, list[str]]:
        """Doc comment, first token and modifiers of what comes; decorators are passed over."""
        doc = None
        while self.i < len(self.tokens) and self.tokens[self.i].kind == "doc":
            doc = doc or self.text()
            self.i += 1
        begin, modifiers = self.i, []
        while self.i < len(self.tokens):
            if self.text().startswith("@"):
                self.i += 1
                while self.text() == ".":
                    self.i += 2
                if self.text() == "(":
                    self.i = self.closing(self.i) + 1
            elif self.text() in _MODIFIERS and self.text(1) not in ("(", ":", "=", "?", ";", "!", "<", "") or (self.text() == "const" and self.text(1) == "enum"):
                modifiers.append(self.text())
                self.i += 1
            else:
                break
        return doc, begin, modifiers

    def guess(self, a: int, b: int, constant: bool) -> str:
        """The type of the expression from token ``a`` to before ``b``."""
        if a >= b:
            return "any"
        t = self.tokens[a]
        if b - a == 1:
            if t.kind == "string":
                return '"' + t.text[1:-1] + '"' if constant else "string"
            if t.kind == "number":
                return t.text if constant else "number"
            if t.text in ("true", "false"):
                return t.text if constant else "boolean"
            if t.kind == "tick":
                return "string"
            if t.kind == "regex":
                return "RegExp"
        if t.text == "new" and a + 1 < b:
            k = a + 1
            while k + 2 < b and self.tokens[k + 1].text == ".":
                k += 2
            if k + 1 < b and self.tokens[k + 1].text == "<":
                k = self.angle(k + 1)
            return self.slice(a + 1, k)
        if t.text == "async":
            a += 1
        if a < b and self.tokens[a].text == "(":
            close = self.closing(a)
            k = close + 1
            result = "any"
            if k < b and self.tokens[k].text == ":":
                arrow = next((j for j in range(k, b) if self.tokens[j].text == "=>"), b)
                result = self.slice(k + 1, arrow - 1)
                k = arrow
            if k < b and self.tokens[k].text == "=>":
                return f"({self.params(a, close)}) => {result}"
        return "any[]" if t.text == "[" else "any"

    def params(self, a: int, b: int) -> str:
        """Parameters between the brackets at ``a`` and ``b``."""
        shown = []
        for x, y in self.split(a + 1, b):
            words = []
            while x < y and (self.tokens[x].text in _MODIFIERS and x + 1 < y and self.tokens[x + 1].kind == "word" or self.tokens[x].kind == "doc" or self.tokens[x].text.startswith("@")):
                if self.tokens[x].text.startswith("@"):
                    x = self.closing(x + 1) if x + 1 < y and self.tokens[x + 1].text == "(" else x
                elif self.tokens[x].kind != "doc":
                    words.append(self.tokens[x].text)
                x += 1
            if x >= y:
                continue
            rest = self.tokens[x].text == "..."
            x += rest
            if x >= y:
                continue
            end = self.closing(x) if self.tokens[x].text in _OPENS else x
            name, k = self.slice(x, end), end + 1
            optional = k < y and self.tokens[k].text == "?"
            k += optional
            equals = self.equals(k, y)
            if k < y and self.tokens[k].text == ":":
                kind = self.slice(k + 1, equals - 1)
            elif equals < y:
                kind = self.guess(equals + 1, y, constant=False)
            else:
                kind = "any[]" if rest else "any"
            shown.append(" ".join([*words, f"{name}{'?' if optional or rest or equals < y else ''}: {kind}"]))
        return ", ".join(shown)

    def equals(self, a: int, b: int) -> int:
        """The first ``=`` outside brackets from ``a`` on, or ``b``."""
        k = a
        while k < b:
            t = self.tokens[k]
            if t.text == "=" and t.kind == "sign":
                return k
            if t.kind == "sign" and t.text in _OPENS:
                k = self.closing(k)
            k += 1
        return b

    def callable(self, modifiers: list[str], ord_: int | None = None) -> tuple[str, str, bool, int]:
        """At a ``<`` or ``(``: parameters, return type, whether there is a body, and the last token.

        A body without a return type is left to be looked at under the next declaration's number.
        """
        if self.text() == "<":
            self.i = self.angle(self.i) + 1
        close = self.closing(self.i) if self.text() == "(" else self.i
        params, k = self.params(self.i, close), close + 1
        kind = ""
        if k < len(self.tokens) and self.tokens[k].text == ":":
            begin = k = k + 1
            while k < len(self.tokens):
                t = self.tokens[k].text
                if t == ";" or (t == "{" and k > begin and not _GOES_ON.fullmatch(self.tokens[k - 1].text)):
                    break
                if k > begin and self.new_line(k) and not _GOES_ON.fullmatch(self.tokens[k - 1].text) and not _COMES_ON.fullmatch(t):
                    break
                k = (self.angle(k) if t == "<" else self.closing(k) if t in _OPENS else k) + 1
            kind = self.slice(begin, k - 1)
        body = k < len(self.tokens) and self.tokens[k].text == "{"
        end = self.closing(k) if body else k if k < len(self.tokens) and self.tokens[k].text == ";" else k - 1
        if not kind:
            returns = body and any(self.tokens[j].text == "return" and self.tokens[j + 1].text not in (";", "}") for j in range(k, min(end, len(self.tokens) - 1)))
            kind = "any" if returns or not body else "void"
            kind = f"Promise<{kind}>" if "async" in modifiers else kind
            if returns and ord_ is not None:
                self.pending.append({"ord": ord_, "body": (k, end), "async": "async" in modifiers})
        return params, kind, body, end

    def read(self) -> list[dict]:
        while self.i < len(self.tokens):
            before = self.i
            self.top()
            self.statement += 1
            self.i = max(self.i, before + 1)
        settle(self, self.pending)
        return self.out

    def top(self) -> None:
        doc, begin, modifiers = self.lead()
        word, after = self.text(), self.text(1)
        shown = " ".join(modifiers)
        if word == "import" and after not in ("(", "."):
            end = self.end_of_statement(self.i)
            module = [t.text for t in self.tokens[self.i : end + 1] if t.kind == "string"]
            self.add("import", begin, end, names=[module[-1][1:-1]] if module else [])
        elif word == "class":
            end = self.class_(doc, begin, shown)
        elif word in ("interface", "enum", "namespace", "module", "global") and self.tokens[self.i + 1 : self.i + 2] and (self.tokens[self.i + 1].kind in ("word", "string") or after == "{"):
            k = self.i
            while k < len(self.tokens) and self.tokens[k].text != "{":
                k = self.angle(k) + 1 if self.tokens[k].text == "<" else k + 1
            end = self.closing(k) if k < len(self.tokens) else len(self.tokens) - 1
            if word in ("interface", "enum"):
                self.add(word, begin, end, name=after, modifiers=shown)
        elif word == "type" and self.tokens[self.i + 1 : self.i + 2] and self.tokens[self.i + 1].kind == "word":
            end = self.end_of_statement(self.i)
            self.add("type", begin, end, name=after, modifiers=shown)
        elif word == "function":
            generator = after == "*"
            self.i += 1 + generator
            name = None
            if self.i < len(self.tokens) and self.tokens[self.i].kind == "word":
                name = self.text()
                self.i += 1
            params, kind, body, end = self.callable(modifiers, None if generator else len(self.out))
            if body or "declare" in modifiers:
                self.add("function", begin, end, name=name, modifiers=shown, params=params, type=kind, doc=doc)
        elif word in ("const", "let", "var"):
            end = self.end_of_statement(self.i)
            last = end + (self.tokens[end].text != ";")
            for x, y in self.split(self.i + 1, last):
                k = (self.closing(x) if self.tokens[x].text in _OPENS else x) + 1
                named = k - 1
                k += k < y and self.tokens[k].text == "!"
                equals = self.equals(k, y)
                noted = k < y and self.tokens[k].text == ":"
                kind = self.slice(k + 1, equals - 1) if noted else self.guess(equals + 1, y, word == "const") if equals < y else "any"
                if not noted and equals < y:
                    self.pending.append({"ord": len(self.out), "init": (equals + 1, y), "constant": word == "const"})
                self.add("variable", x, y - 1, name=self.slice(x, named), modifiers=shown, head=word, type=kind, init=self.slice(equals + 1, y - 1) if equals < y else None, doc=doc)
        elif modifiers[:1] == ["export"] or word == "export":
            default = "default" in modifiers or after in ("=", "default")
            if word == "export":
                self.i += 1
            end = self.end_of_statement(self.i)
            if default:
                self.add("assignment", begin, end)
            else:
                listed = self.split(self.i + 1, self.closing(self.i)) if self.text() == "{" else []
                skip = lambda x: x + (self.tokens[x].text == "type")
                self.add("export", begin, end, names=[self.tokens[min(skip(x), y - 1)].text for x, y in listed])
        else:
            end = self.end_of_statement(self.i)
            if self.text() == "{" or word in ("if", "for", "while", "try", "switch", "do"):
                k = self.i
                while k < len(self.tokens) and self.tokens[k].text != "{":
                    k = self.closing(k) + 1 if self.tokens[k].text in _OPENS else k + 1
                end = max(end, self.closing(k)) if k < len(self.tokens) else end
        self.i = max(self.i, end + 1)

    def class_(self, doc: str | None, begin: int, shown: str) -> int:
        self.i += 1
        name = None
        if self.i < len(self.tokens) and self.tokens[self.i].kind == "word" and self.text() not in ("extends", "implements"):
            name = self.text()
            self.i += 1
        head = ""
        if self.text() == "<":
            close = self.angle(self.i)
            head = "<" + ", ".join(self.slice(x, y - 1) for x, y in self.split(self.i + 1, close)) + ">"
            self.i = close + 1
        for word in ("extends", "implements"):
            if self.text() == word:
                a = k = self.i + 1
                while k < len(self.tokens) and self.tokens[k].text not in ("{", "implements"):
                    k = (self.angle(k) if self.tokens[k].text == "<" else self.closing(k) if self.tokens[k].text in _OPENS else k) + 1
                head += f" {word} " + (", ".join(self.slice(x, y - 1) for x, y in self.split(a, k)) if word == "implements" else self.slice(a, k - 1))
                self.i = k
        end = self.closing(self.i) if self.text() == "{" else len(self.tokens) - 1
        me = self.add("class", begin, end, name=name, modifiers=shown, head=head, doc=doc)
        self.i += 1
        while self.i < end:
            before = self.i
            self.member(me, end)
            self.i = max(self.i, before + 1)
        self.i = end + 1
        return end

    def member(self, parent: int, stop: int) -> None:
        doc, begin, modifiers = self.lead()
        if self.i >= stop:
            return
        if self.text() == ";":
            self.i += 1
            return
        if self.text() == "{":  # a static block
            self.i = self.closing(self.i) + 1
            return
        generator = self.text() == "*"
        accessor = self.text() in ("get", "set") and self.text(1) not in ("(", ":", "=", "?", ";", "!", "<", "}")
        self.i += accessor or self.text() == "*"
        key = self.i
        last = self.closing(key) if self.text() == "[" else key
        name = self.slice(key, last)
        self.i = last + 1
        optional = self.text() in ("?", "!")
        self.i += optional
        if self.text() in ("(", "<"):
            params, kind, body, end = self.callable(modifiers, None if generator or accessor or name == "constructor" else len(self.out))
            if not accessor and (body or "abstract" in modifiers or "declare" in modifiers):
                self.add("constructor" if name == "constructor" else "method", begin, end, parent=parent, name=name, modifiers=" ".join(modifiers), params=params, type=kind, doc=doc)
        else:
            end = self.end_of_statement(self.i, stop)
            last = end + (self.tokens[end].text != ";")
            equals = self.equals(self.i, last)
            noted = self.text() == ":"
            kind = self.slice(self.i + 1, equals - 1) if noted else self.guess(equals + 1, last, "readonly" in modifiers) if equals < last else "any"
            if not noted and equals < last:
                self.pending.append({"ord": len(self.out), "init": (equals + 1, last), "constant": "readonly" in modifiers})
            if self.tokens[key].text != "[" or equals < last:  # else an index signature
                self.add("property", begin, end, parent=parent, name=name, modifiers=" ".join(modifiers), type=kind, doc=doc)
        self.i = max(self.i, end + 1)


def read(source: str) -> list[dict]:
    """The declarations of one source."""
    return _Reader(source).read()


@F.pandas_udf(PARSED)
def declarations(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each content: items, the declarations, and error, what went wrong (then no items)."""
    for content in contents:
        rows = []
        for source in content:
            try:
                rows.append(([{n: d[n] for n, _ in FIELDS} for d in read(source or "")], None))
            except Exception as e:  # a file that can't be read is reported in its skeleton
                rows.append(([], str(e) or "Unknown error"))
        yield pd.DataFrame({"items": [r[0] for r in rows], "error": [r[1] for r in rows]})
