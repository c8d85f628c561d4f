"""A template compiler for conversations.

A small sandboxed language is parsed into a syntax tree, constants are folded, and the tree
becomes nested Python closures. The language has text, `{{ expression }}`, `{# comment #}`,
`{% if %} {% elif %} {% else %} {% endif %}`, `{% for x in list %} {% endfor %}`,
`{% set x = expression %}` and `{% generation %} {% endgeneration %}`; a dash inside a
tag trims the white space next to it. Expressions have literals, names, `a.b` and `a['b']`,
comparison, `in`, arithmetic, `~`, `and or not`, `a if c else b`, and filters.

Sandbox: `.` and `[]` look up keys of mappings and places of lists, never Python attributes;
there are no calls but the listed filters, and no loops but over a value that is there. So a
template cannot reach anything that was not passed to it.

Rendering gives the text and the spans of code points made inside generation blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template, or a value it was given, does not fit the language."""


# tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    values: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# lexer and parser

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%~<>()\[\].,|]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORD_OPS = {"and", "or", "not", "in", "if", "else", "is"}
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            out.append(("const", float(m[1]) if "." in m[1] else int(m[1])))
        elif m[2]:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[2][1:-1], flags=re.S)))
        elif m[3] in _LITERALS:
            out.append(("const", _LITERALS[m[3]]))
        else:
            out.append(("op" if m[4] or m[3] in _WORD_OPS else "name", m[3] or m[4]))
    return out


class _Expression:
    """Precedence climbing over the tokens of one tag."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "/", "%"))

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self) -> Any:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def choice(self) -> Any:
        node = self.level(0)
        if self.take("if"):
            test = self.level(0)
            other = self.choice() if self.take("else") else Const("")
            return Op("?", (test, node, other))
        return node

    def level(self, n: int) -> Any:
        if n == len(self.LEVELS):
            return self.unary()
        if n == 2 and self.take("not"):
            return Op("not", (self.level(2),))
        node = self.level(n + 1)
        while True:
            if sign := self.take(*self.LEVELS[n]):
                node = Op(sign, (node, self.level(n + 1)))
            elif n == 2 and self.tokens[self.at : self.at + 2] == [("op", "not"), ("op", "in")]:
                self.at += 2
                node = Op("not", (Op("in", (node, self.level(n + 1))),))
            else:
                return node

    def unary(self) -> Any:
        return Op("neg", (self.unary(),)) if self.take("-") else self.tail(self.atom())

    def atom(self) -> Any:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("["):
            return Op("list", self.listed("]"))
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.name())

    def listed(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            out.append(self.choice())
            if not self.take(","):
                self.need(end)
                break
        return tuple(out)

    def tail(self, node: Any) -> Any:
        while True:
            if self.take("."):
                node = Item(node, Const(self.name()))
            elif self.take("["):
                node = Item(node, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                node = Filter(name, (node, *(self.listed(")") if self.take("(") else ())))
            else:
                return node


def _pieces(source: str) -> list[tuple[str, str]]:
    out, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if m[1] or m[4] or m[7] else text
        if text:
            out.append(("text", text))
        if m[2] is not None:
            out.append(("out", m[2]))
        elif m[5] is not None:
            out.append(("tag", m[5].strip()))
        trim, at = bool(m[3] or m[6] or m[8]), m.end()
    rest = source[at:].lstrip() if trim else source[at:]
    if "{%" in rest or "{{" in rest:
        raise TemplateError("a tag is not closed")
    return [*out, ("text", rest)] if rest else out


class _Parser:
    def __init__(self, source: str):
        self.pieces, self.at = _pieces(source), 0

    def block(self, *ends: str) -> tuple[tuple, str]:
        out: list[Any] = []
        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(Out(Const(text)))
            elif kind == "out":
                out.append(Out(_Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), text
                out.append(self.statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), ""

    def statement(self, word: str, rest: str) -> Any:
        if word == "if":
            return self.branch(rest)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for is not understood: {rest!r}")
            return For(m[1], _Expression(m[2]).whole(), self.block("endfor")[0])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set is not understood: {rest!r}")
            return Set(m[1], _Expression(m[2]).whole())
        if word == "generation":
            return Generation(self.block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    def branch(self, test: str) -> If:
        then, end = self.block("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif"):
            other = (self.branch(end[4:]),)
        elif end == "else":
            other = self.block("endif")[0]
        return If(_Expression(test).whole(), then, other)


# values


def _number(x: Any) -> Any:
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise TemplateError(f"{type(x).__name__} is not a number")
    return x


def text_of(x: Any) -> str:
    if x is None or isinstance(x, Missing):
        return ""
    return ("true" if x else "false") if isinstance(x, bool) else str(x)


@dataclass(frozen=True)
class Missing:
    """What an unknown name or key gives: false, empty, equal to nothing but itself."""

    def __bool__(self) -> bool:
        return False


MISSING = Missing()


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b)


def _holds(a: Any, b: Any) -> bool:
    return text_of(a) in b if isinstance(b, str) else isinstance(b, list | tuple | dict) and a in b


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, MISSING)
    if isinstance(of, list | tuple) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return MISSING


SIGNS: dict[str, Callable[..., Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": _holds,
    "+": _plus,
    "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b),
    "/": lambda a, b: _number(a) / _number(b),
    "%": lambda a, b: _number(a) % _number(b),
    "~": lambda a, b: text_of(a) + text_of(b),
    "not": lambda a: not a,
    "neg": lambda a: -_number(a),
    "list": lambda *a: list(a),
}

FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(x) if isinstance(x, str | list | tuple | dict) else 0,
    "default": lambda x, other="": other if isinstance(x, Missing) or x is None else x,
    "first": lambda x: x[0] if x else MISSING,
    "last": lambda x: x[-1] if x else MISSING,
    "escape": lambda x: x,  # replaced by the escape of the format at hand
}


def fold(node: Any) -> Any:
    """The tree with what is known beforehand worked out and texts side by side joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for part in (fold(n) for n in node):
            for x in part if isinstance(part, tuple) else (part,):
                if isinstance(x, Out) and isinstance(x.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(text_of(out[-1].value.value) + text_of(x.value.value)))
                else:
                    out.append(x)
        return tuple(out)
    if isinstance(node, Out):
        value = fold(node.value)
        return Out(Const(text_of(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, If):
        test, then, other = fold(node.test), fold(node.then), fold(node.other)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, For):
        return For(node.name, fold(node.values), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Filter):
        args = tuple(fold(a) for a in node.args)
        known = node.name != "escape" and all(isinstance(a, Const) for a in args)
        return Const(FILTERS[node.name](*(a.value for a in args))) if known else Filter(node.name, args)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if node.sign == "?" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if node.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        if node.sign in SIGNS and all(isinstance(a, Const) for a in args):
            return Const(SIGNS[node.sign](*(a.value for a in args)))
        return Op(node.sign, args)
    return node


# closures


@dataclass
class Sink:
    """Collects text and the spans of generated text, in code points."""

    texts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def put(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)


Scope = dict[str, Any]


def _value(node: Any, escape: Callable[[str], str]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n, MISSING)
    if isinstance(node, Item):
        of, key = _value(node.of, escape), _value(node.key, escape)
        return lambda scope: _item(of(scope), key(scope))
    args = [_value(a, escape) for a in node.args]
    if isinstance(node, Filter):
        if node.name == "escape":
            return lambda scope: escape(text_of(args[0](scope)))
        act = FILTERS[node.name]
        return lambda scope: act(*(a(scope) for a in args))
    if node.sign == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.sign == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if node.sign == "?":
        return lambda scope: args[1](scope) if args[0](scope) else args[2](scope)
    sign = SIGNS[node.sign]
    if len(args) == 2:
        left, right = args
        return lambda scope: sign(left(scope), right(scope))
    return lambda scope: sign(*(a(scope) for a in args))


Step = Callable[[Scope, Sink], None]


def _steps(nodes: Iterable[Any], escape: Callable[[str], str]) -> Step:
    steps = [_step(n, escape) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: Scope, sink: Sink) -> None:
        for s in steps:
            s(scope, sink)

    return run


def _step(node: Any, escape: Callable[[str], str]) -> Step:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            return lambda scope, sink, text=node.value.value: sink.put(text)
        value = _value(node.value, escape)
        return lambda scope, sink: sink.put(text_of(value(scope)))
    if isinstance(node, If):
        test, then, other = _value(node.test, escape), _steps(node.then, escape), _steps(node.other, escape)
        return lambda scope, sink: then(scope, sink) if test(scope) else other(scope, sink)
    if isinstance(node, Set):
        value = _value(node.value, escape)
        return lambda scope, sink, name=node.name: scope.__setitem__(name, value(scope))
    if isinstance(node, Generation):
        body = _steps(node.body, escape)

        def generated(scope: Scope, sink: Sink) -> None:
            start = sink.length
            body(scope, sink)
            sink.spans.append((start, sink.length))

        return generated
    values, body = _value(node.values, escape), _steps(node.body, escape)

    def loop(scope: Scope, sink: Sink) -> None:
        found = values(scope)
        if not isinstance(found, list | tuple):
            raise TemplateError(f"for needs a list, not {type(found).__name__}")
        each(scope, sink, found, 0, len(found), node.name, body)

    return loop


def each(scope: Scope, sink: Sink, values: list | tuple, first: int, total: int, name: str, body: Step) -> None:
    """Run a loop's body over values that are those from `first` on of a list of `total`."""
    inner = dict(scope)
    for i, value in enumerate(values, first):
        inner[name] = value
        inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == total - 1, "length": total}
        body(inner, sink)


class Template:
    """A compiled template. `escape` is what the filter of that name does."""

    def __init__(self, source: str, escape: Callable[[str], str] = lambda x: x):
        self.source, self.tree = source, fold(_Parser(source).block()[0])
        self._all = _steps(self.tree, escape)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For) and n.values == Name("messages")]
        self._loop: tuple[Step, str, Step, Step] | None = None
        if len(loops) == 1:
            k = loops[0]
            before, after = self.tree[:k], self.tree[k + 1 :]
            if not any(isinstance(n, Set) for n in (*before, *after)) and "messages" not in _names((before, self.tree[k].body, after)):
                self._loop = (_steps(before, escape), self.tree[k].name, _steps(self.tree[k].body, escape), _steps(after, escape))

    def render(self, messages: list[dict[str, Any]], **values: Any) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        self._all({"messages": messages, **values}, sink)
        return "".join(sink.texts), sink.spans

    @property
    def in_pieces(self) -> bool:
        """Whether stretches of a conversation can be rendered apart."""
        return self._loop is not None

    def render_piece(self, messages: list[dict[str, Any]], first: int, total: int, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text of messages `first` and on out of `total`, with what stands before and after all of them."""
        if self._loop is None:
            raise TemplateError("this template needs the whole conversation at once")
        before, name, body, after = self._loop
        sink = Sink()
        if first == 0:
            before(dict(values), sink)
        each(values, sink, messages, first, total, name, body)
        if first + len(messages) == total:
            after(dict(values), sink)
        return "".join(sink.texts), sink.spans


def _names(node: Any) -> set[str]:
    if isinstance(node, tuple):
        return set().union(*map(_names, node))
    if isinstance(node, Name):
        return {node.name}
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*(_names(getattr(node, f)) for f in node.__dataclass_fields__ if f != "name"), set())
    return set()
