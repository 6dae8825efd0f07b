"""Chat templates written in the usual template language, compiled to one Column expression.

What is known: text, {{ }}, {# #}, for, if / elif / else, set, white-space marks; strings, whole numbers, true, false, lists of these, + - ~ %, comparisons,
in, and, or, not, `a if c else b`, is defined, x['name'], x.name, x[0], x[1:], the filters trim, length, upper, lower, .strip(), loop.first, loop.last, loop.index,
loop.index0, loop.length and raise_exception(text). Anything else raises ValueError when the plan is made, never while it runs. A newline
behind a block goes, and so do blanks in front of one at a line's start, as chat templates are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import let, strip

_BODY = r"(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?"
_PIECE = re.compile(rf"\{{\{{([-+]?)({_BODY})(-?)\}}\}}|\{{%([-+]?)({_BODY})(-?)%\}}|\{{#(-?)(.*?)(-?)#\}}", re.S)
_WORD = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~%<>=|.,:()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Value:
    """kind: text, int, bool, list (of messages), message or literals (Python values)."""

    kind: str
    col: Any


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, body) with kind text, print or block; comments are gone and white space is trimmed."""
    out: list[tuple[str, str]] = []
    at, eat, newline = 0, False, False

    def text(s: str, left: bool, block: bool) -> None:
        if eat:
            s = s.lstrip()
        elif newline:
            s = s.removeprefix("\n")
        if left:
            s = s.rstrip()
        elif block:
            line = s.rfind("\n") + 1
            if not s[line:].strip(" \t") and (line or not out or newline):
                s = s[:line]
        if s:
            if "{%" in s or "{{" in s or "{#" in s:
                raise ValueError(f"a tag of the template isn't closed: {s[:40]!r}")
            out.append(("text", s))

    source = source.removesuffix("\n")
    for m in _PIECE.finditer(source):
        kind = "print" if m[2] is not None else "block" if m[5] is not None else "comment"
        open_, body, close = (m[i] for i in {"print": (1, 2, 3), "block": (4, 5, 6), "comment": (7, 8, 9)}[kind])
        text(source[at : m.start()], open_ == "-", kind != "print" and open_ != "+")
        if kind != "comment":
            out.append((kind, body.strip()))
        at, eat, newline = m.end(), close == "-", kind != "print"
    text(source[at:], False, False)
    return out


class _Expressions:
    """One expression's words to a tree of tuples."""

    def __init__(self, body: str):
        self.body, self.words, at = body, [], 0
        body = body.rstrip()
        while at < len(body):
            m = _WORD.match(body, at)
            if not m:
                raise ValueError(f"can't read {body[at:]!r} in the template's {body!r}")
            self.words.append(("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1][1:-1], flags=re.S)) if m[1] else ("int", int(m[2])) if m[2] else ("name", m[3]) if m[3] else ("mark", m[4]))
            at = m.end()
        self.at = 0

    def peek(self, *marks: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] in ("mark", "name") and self.words[self.at][1] in marks

    def take(self, *marks: str) -> str | None:
        if self.peek(*marks):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ValueError(f"{mark!r} is missing in the template's {self.body!r}")

    def name(self) -> str:
        if self.at < len(self.words) and self.words[self.at][0] == "name":
            self.at += 1
            return self.words[self.at - 1][1]
        raise ValueError(f"a name is missing in the template's {self.body!r}")

    def end(self, tree: tuple) -> tuple:
        if self.at < len(self.words):
            raise ValueError(f"unknown in a template: {self.words[self.at][1]!r} in {self.body!r}")
        return tree

    def whole(self) -> tuple:
        return self.end(self.choice())

    def choice(self) -> tuple:
        tree = self.either()
        if self.take("if"):
            test = self.either()
            tree = ("choice", test, tree, self.choice() if self.take("else") else ("text", ""))
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.sum()
        while True:
            if op := self.take("==", "!=", "<", ">", "<=", ">="):
                tree = (op, tree, self.sum())
            elif self.take("in"):
                tree = ("in", tree, self.sum())
            elif self.peek("not"):
                self.at += 1
                self.need("in")
                tree = ("not", ("in", tree, self.sum()))
            elif self.take("is"):
                no = self.take("not")
                self.need("defined")
                tree = ("not", ("defined", tree)) if no else ("defined", tree)
            else:
                return tree

    def sum(self) -> tuple:
        tree = self.rest()
        while op := self.take("+", "-", "~"):
            tree = (op, tree, self.rest())
        return tree

    def rest(self) -> tuple:
        tree = self.filtered()
        while self.take("%"):
            tree = ("%", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.primary()
        while True:
            if self.take("."):
                field = self.name()
                if self.take("("):
                    self.need(")")
                    tree = ("filter", {"strip": "trim"}.get(field, f"{field}()"), tree)
                else:
                    tree = ("field", tree, field)
            elif self.take("["):
                if self.take(":"):
                    raise ValueError(f"unknown in a template: a slice without a start in {self.body!r}")
                key = self.choice()
                tree = ("from", tree, key) if self.take(":") else ("item", tree, key)
                self.need("]")
            elif self.take("|"):
                tree = ("filter", self.name(), tree)
            else:
                return tree

    def primary(self) -> tuple:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.peek("]"):
                    self.need(",")
            return ("literals", items)
        if self.take("-"):
            return ("-", ("int", 0), self.filtered())
        if self.at >= len(self.words) or self.words[self.at][0] == "mark":
            raise ValueError(f"a value is missing in the template's {self.body!r}")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "name" and word in ("true", "True", "false", "False"):
            return ("bool", word in ("true", "True"))
        if kind == "name" and self.take("("):
            argument = self.choice()
            self.need(")")
            return ("call", word, argument)
        return (kind, word)


@lru_cache(maxsize=256)
def parse(source: str) -> tuple:
    """A template's tree."""
    pieces, at = _pieces(source), 0

    def block(ends: tuple[str, ...]) -> tuple[list, str, _Expressions | None]:
        nonlocal at
        out: list[tuple] = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            if kind == "text":
                out.append(("print", ("text", body)))
            elif kind == "print":
                out.append(("print", _Expressions(body).whole()))
            else:
                e = _Expressions(body)
                tag = e.name()
                if tag in ends:
                    return out, tag, e
                if tag == "set":
                    name = e.name()
                    e.need("=")
                    out.append(("set", name, e.whole()))
                elif tag == "for":
                    name = e.name()
                    e.need("in")
                    over = e.whole()
                    inner, _, _ = block(("endfor",))
                    out.append(("for", name, over, inner))
                elif tag == "if":
                    arms, test = [], e.whole()
                    while True:
                        inner, tag, more = block(("elif", "else", "endif"))
                        arms.append((test, inner))
                        if tag == "endif":
                            out.append(("if", arms, []))
                            break
                        if tag == "else":
                            other, _, _ = block(("endif",))
                            out.append(("if", arms, other))
                            break
                        test = more.whole()
                else:
                    raise ValueError(f"unknown in a template: {tag!r}")
        if ends:
            raise ValueError(f"a template lacks {ends[-1]!r}")
        return out, "", None

    return tuple(block(())[0])


def _text(v: Value) -> Column:
    if v.kind == "text":
        return v.col
    if v.kind == "int":
        return v.col.cast("string")
    raise ValueError(f"a template can't print or join a value of the kind {v.kind}")


def _truth(v: Value) -> Column:
    tests: dict[str, Callable[[Any], Column]] = {"bool": lambda c: c, "text": lambda c: c != "", "int": lambda c: c != 0, "list": lambda c: F.size(c) > 0}
    if v.kind not in tests:
        raise ValueError(f"a template can't test a value of the kind {v.kind}")
    return F.coalesce(tests[v.kind](v.col), F.lit(False))


class _Compiler:
    def value(self, tree: tuple, names: dict[str, Value]) -> Value:
        kind = tree[0]
        if kind in ("text", "int", "bool"):
            return Value(kind, F.lit(tree[1]))
        if kind == "name":
            if tree[1] not in names:
                raise ValueError(f"unknown in a template: {tree[1]!r}")
            return names[tree[1]]
        if kind == "literals":
            if any(t[0] not in ("text", "int") for t in tree[1]):
                raise ValueError("a template's list may hold strings and whole numbers only")
            return Value("literals", [t[1] for t in tree[1]])
        if kind == "defined":
            t = tree[1]
            return Value("bool", F.lit(t[1] in names) if t[0] == "name" else self.value(t, names).col.isNotNull())
        if kind == "choice":
            test, a, b = _truth(self.value(tree[1], names)), self.value(tree[2], names), self.value(tree[3], names)
            return self.merged(test, a, b)
        if kind == "not":
            return Value("bool", ~_truth(self.value(tree[1], names)))
        if kind == "call":
            if tree[1] != "raise_exception":
                raise ValueError(f"unknown in a template: {tree[1]!r}")
            return Value("text", F.raise_error(_text(self.value(tree[2], names))).cast("string"))
        if kind == "filter":
            v = self.value(tree[2], names)
            if tree[1] == "length" and v.kind in ("list", "text"):
                return Value("int", F.size(v.col) if v.kind == "list" else F.length(v.col))
            changes = {"trim": strip, "upper": F.upper, "lower": F.lower}
            if tree[1] not in changes or v.kind != "text":
                raise ValueError(f"unknown in a template: {tree[1]!r} of the kind {v.kind}")
            return Value("text", changes[tree[1]](v.col))
        if kind == "field":
            if tree[1] == ("name", "loop"):
                return self.value(("name", f"loop.{tree[2]}"), names)
            return self.item(self.value(tree[1], names), tree[2])
        if kind == "item":
            of, key = self.value(tree[1], names), tree[2]
            return self.item(of, key[1] if key[0] == "text" else self.value(key, names))
        if kind == "from":
            of, start = self.value(tree[1], names), self.value(tree[2], names)
            if of.kind != "list" or start.kind != "int":
                raise ValueError("a template can cut lists of messages at whole numbers only")
            n = F.size(of.col)
            first = F.least(F.when(start.col < 0, F.greatest(n + start.col, F.lit(0))).otherwise(start.col), n)
            return Value("list", F.slice(of.col, first + 1, n - first))
        a, b = self.value(tree[1], names), self.value(tree[2], names)
        if kind in ("and", "or"):
            return Value("bool", _truth(a) & _truth(b) if kind == "and" else _truth(a) | _truth(b))
        if kind == "in":
            if a.kind == b.kind == "text":
                return Value("bool", F.contains(b.col, a.col))
            if b.kind != "literals":
                raise ValueError("a template can look for texts in texts and values in lists of literals only")
            return Value("bool", a.col.isin(*[x for x in b.col if isinstance(x, str) == (a.kind == "text")]))
        if kind == "~" or (kind == "+" and a.kind == b.kind == "text"):
            return Value("text", F.concat(_text(a), _text(b)))
        if kind in ("==", "!=") and a.kind != b.kind and {a.kind, b.kind} <= {"text", "int", "bool"}:
            return Value("bool", F.lit(kind == "!="))  # values of two kinds are never equal
        if a.kind != b.kind or a.kind not in ("text", "int", "bool") or (kind in "+-%" and a.kind != "int"):
            raise ValueError(f"a template can't use {kind!r} between the kinds {a.kind} and {b.kind}")
        ops: dict[str, Callable[[], Column]] = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "%": lambda: F.pmod(a.col, b.col), "==": lambda: a.col == b.col, "!=": lambda: a.col != b.col}
        ops |= {"<": lambda: a.col < b.col, ">": lambda: a.col > b.col, "<=": lambda: a.col <= b.col, ">=": lambda: a.col >= b.col}
        return Value("int" if kind in "+-%" else "bool", ops[kind]())

    def item(self, of: Value, key: Any) -> Value:
        if of.kind == "message" and isinstance(key, str):
            return Value("text", of.col[key])
        if of.kind == "list" and isinstance(key, Value) and key.kind == "int":
            return Value("message", F.get(of.col, F.when(key.col < 0, F.size(of.col) + key.col).otherwise(key.col)))
        raise ValueError(f"a template can't take an item of the kind {of.kind}")

    @staticmethod
    def merged(test: Column, a: Value, b: Value) -> Value:
        if a.kind != b.kind or a.kind == "literals":
            raise ValueError(f"a template's branches give the kinds {a.kind} and {b.kind}")
        return a if a.col is b.col else Value(a.kind, F.when(test, a.col).otherwise(b.col))

    def run(self, body: list | tuple, names: dict[str, Value]) -> Column:
        """What the body prints; names are changed in place by what it sets."""
        out: list[Column] = []
        for step in body:
            if step[0] == "print":
                out.append(_text(self.value(step[1], names)))
            elif step[0] == "set":
                names[step[1]] = self.value(step[2], names)
            elif step[0] == "for":
                out.append(self.loop(step, names))
            else:
                tests, made, inner = [], [], []
                for test, arm in [*step[1], (None, step[2])]:
                    if test is not None:
                        tests.append(_truth(self.value(test, names)))
                    inner.append(dict(names))
                    made.append(self.run(arm, inner[-1]))
                text, after = made[-1], inner[-1]
                for test, t, own in reversed(list(zip(tests, made, inner))):
                    text = F.when(test, t).otherwise(text)
                    after = {k: self.merged(test, own[k], after[k]) for k in own.keys() & after.keys()}
                out.append(text)
                names.clear()  # what one branch alone sets is unknown behind it
                names.update(after)
        return F.concat(*out) if len(out) > 1 else out[0] if out else F.lit("")

    def loop(self, step: tuple, names: dict[str, Value]) -> Column:
        _, name, over, body = step
        of = self.value(over, names)
        if of.kind != "list":
            raise ValueError(f"a template can loop over messages only, not over the kind {of.kind}")

        def each(m: Column, i: Column) -> Column:
            n = F.size(of.col)
            places = {"first": Value("bool", i == 0), "last": Value("bool", i == n - 1), "index": Value("int", i + 1), "index0": Value("int", i), "length": Value("int", n)}
            # what a turn sets ends with it
            return self.run(body, {**names, name: Value("message", m), **{f"loop.{k}": v for k, v in places.items()}})

        return F.array_join(F.transform(of.col, each), "")


def compiled(source: str, messages: Column, constants: dict[str, str | bool]) -> Column:
    """The text that a template prints of an array of (role, content). A message with a null content prints nothing."""
    tree = parse(source)
    known = {k: Value("bool" if isinstance(v, bool) else "text", F.lit(v)) for k, v in constants.items()}
    return let(messages, lambda m: _Compiler().run(tree, {"messages": Value("list", m), **known}))
