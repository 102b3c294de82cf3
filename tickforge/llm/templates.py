"""A small template language for conversations, compiled to Python closures.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {# comment #}
    {% for m in messages %} ... {% endfor %}   {% set name = e %}   {% generation %} ... {% endgeneration %}

Expressions: strings, whole numbers, ``true``, ``false``, ``none``, names, ``a.key`` and ``a['key']``, ``not``, ``and``,
``or``, ``==``, ``!=``, ``in``, ``~`` (concatenation), ``x | filter``, brackets, ``a if c else b``. A dash inside a tag takes the
white space next to it. Sandboxed: there are no calls, keys are looked up in mappings only (never
attributes of Python objects), names must be declared, filters are the given ones, and the only loop is
over the messages, which come one by one: a conversation is never held as a whole.

``parse`` gives the tree, ``fold`` computes what is constant (and drops branches that can't be taken),
``compiled`` turns the tree into closures. A compiled template yields text and the marks ``TURN`` (a message
is finished), ``BEGIN`` and ``END`` (around text that the model shall generate).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

TURN, BEGIN, END = ("turn",), ("begin",), ("end",)
Event = str | tuple[str]


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    """``key``, ``not``, ``and``, ``or``, ``==``, ``!=``, ``in``, ``~``, ``if`` or ``|name`` over ``args``."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.\[\]()|~=]))")
_ESCAPES = {"n": "\n", "t": "\t"}


@dataclass
class _Expression:
    tokens: list[tuple[str, str]]
    names: set[str]
    filters: dict[str, Callable]
    at: int = field(default=0)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *texts: str) -> bool:
        kind, text = self.peek()
        if kind != "str" and text in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text} expected, not {self.peek()[1] or 'the end'}")

    def choice(self) -> object:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            value = Op("if", (test, value, self.choice()))
        return value

    def either(self) -> object:
        value = self.both()
        while self.take("or"):
            value = Op("or", (value, self.both()))
        return value

    def both(self) -> object:
        value = self.negated()
        while self.take("and"):
            value = Op("and", (value, self.negated()))
        return value

    def negated(self) -> object:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        value = self.joined()
        for kind in ("==", "!=", "in"):
            if self.take(kind):
                return Op(kind, (value, self.joined()))
        return value

    def joined(self) -> object:
        value = self.filtered()
        while self.take("~"):
            value = Op("~", (value, self.filtered()))
        return value

    def filtered(self) -> object:
        value = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name}")
            self.at += 1
            value = Op(f"|{name}", (value,))
        return value

    def atom(self) -> object:
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "int":
            value = Const(int(text))
        elif text == "(":
            value = self.choice()
            self.need(")")
        elif text in ("true", "false", "none"):
            value = Const({"true": True, "false": False, "none": None}[text])
        elif kind == "name" and text in self.names:
            value = Name(text)
        else:
            raise TemplateError(f"unexpected {text or 'end'}" if kind != "name" else f"no name {text}")
        while True:
            if self.take("."):
                kind, key = self.peek()
                if kind != "name":
                    raise TemplateError("a key expected")
                self.at += 1
                value = Op("key", (value, Const(key)))
            elif self.take("["):
                value = Op("key", (value, self.choice()))
                self.need("]")
            else:
                return value


def _expression(text: str, names: set[str], filters: dict[str, Callable]) -> object:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:].strip()[:10]}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    parser = _Expression(tokens, names, filters)
    value = parser.choice()
    if parser.peek()[0] != "end":
        raise TemplateError(f"unexpected {parser.peek()[1]}")
    return value


def parse(source: str, filters: dict[str, Callable], names: Iterable[str] = ()) -> tuple:
    """The syntax tree of a template; ``names`` are the values it may use besides messages."""
    pieces = _TAG.split(source)
    for i in range(1, len(pieces), 2):  # dashes take white space of the neighbours
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    known, at = set(names), 0

    def block(ends: tuple[str, ...], inside: bool, looped: bool) -> tuple[tuple, str]:
        """Nodes up to one of ``ends``; ``inside``: of a generation, ``looped``: of the loop."""
        nonlocal at, known
        out = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if at % 2:  # text
                if re.search(r"\{%|\{\{", piece):
                    raise TemplateError("a tag does not end")
                out += [Text(piece)] if piece else []
                continue
            body = piece[2:-2].strip("-").strip()
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                out.append(Print(_expression(body, known, filters)))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return tuple(out), body
            if word == "if":
                out.append(branch(rest, inside, looped))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
                out.append(Set(m[1], _expression(m[2], known, filters)))
                known = known | {m[1]}
            elif word == "for" and not looped and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)):
                outer, known = known, known | {m[1], "loop"}
                out.append(For(m[1], block(("endfor",), inside, True)[0]))
                known = outer
            elif word == "generation" and not inside and not rest:
                out.append(Generation(block(("endgeneration",), True, looped)[0]))
            else:
                raise TemplateError(f"unexpected {body}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str, inside: bool, looped: bool) -> If:
        value = _expression(test, known, filters)
        then, end = block(("elif", "else", "endif"), inside, looped)
        word, _, rest = end.partition(" ")
        if word == "elif":
            return If(value, then, (branch(rest, inside, looped),))
        return If(value, then, block(("endif",), inside, looped)[0] if word == "else" else ())

    return block((), False, False)[0]


def _shown(value: object) -> str:
    return "" if value is None else {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)


def _key(value: object, key: object) -> object:
    return value.get(key) if isinstance(value, dict) else None


_PURE: dict[str, Callable] = {
    "key": _key, "not": lambda a: not a, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b if isinstance(b, (str, dict)) and isinstance(a, str) else False, "~": lambda a, b: _shown(a) + _shown(b),
}


def _folded(value: object, filters: dict[str, Callable]) -> object:
    if not isinstance(value, Op):
        return value
    args = tuple(_folded(a, filters) for a in value.args)
    first = args[0]
    if isinstance(first, Const):
        if value.kind == "if":
            return args[1] if first.value else args[2]
        if value.kind in ("and", "or"):
            return args[1] if bool(first.value) == (value.kind == "and") else first
    if all(isinstance(a, Const) for a in args) and (value.kind in _PURE or value.kind[0] == "|"):
        return Const((_PURE.get(value.kind) or (lambda x: filters[value.kind[1:]](_shown(x))))(*[a.value for a in args]))
    return Op(value.kind, args)


def fold(nodes: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Print):
            value = _folded(node.value, filters)
            node = Text(_shown(value.value)) if isinstance(value, Const) else Print(value)
        elif isinstance(node, Set):
            node = Set(node.name, _folded(node.value, filters))
        elif isinstance(node, If):
            test, then, other = _folded(node.test, filters), fold(node.then, filters), fold(node.other, filters)
            if isinstance(test, Const):
                out += then if test.value else other
                continue
            node = If(test, then, other)
        elif isinstance(node, For):
            node = For(node.name, fold(node.body, filters))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body, filters))
        out.append(node)
    joined: list = []
    for node in out:
        if isinstance(node, Text) and joined and isinstance(joined[-1], Text):
            joined[-1] = Text(joined[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            joined.append(node)
    return tuple(joined)


def _value(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env: node.value
    if isinstance(node, Name):
        return lambda env: env.get(node.name)
    args = [_value(a, filters) for a in node.args]
    if node.kind[0] == "|":
        change, (one,) = filters[node.kind[1:]], args
        return lambda env: change(_shown(one(env)))
    if node.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.kind == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    pure = _PURE[node.kind]
    if len(args) == 1:
        return lambda env: pure(args[0](env))
    return lambda env: pure(args[0](env), args[1](env))


def _runs(nodes: tuple, filters: dict[str, Callable]) -> Callable[[dict], Iterator[Event]]:
    steps = [_run(n, filters) for n in nodes]

    def run(env: dict) -> Iterator[Event]:
        for step in steps:
            yield from step(env)
    return run


def _run(node: object, filters: dict[str, Callable]) -> Callable[[dict], Iterator[Event]]:
    if isinstance(node, Text):
        return lambda env: iter((node.text,))
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda env: iter((_shown(value(env)),))
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def assign(env: dict) -> Iterator[Event]:
            env[node.name] = value(env)
            return iter(())
        return assign
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _runs(node.then, filters), _runs(node.other, filters)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Generation):
        body = _runs(node.body, filters)

        def generated(env: dict) -> Iterator[Event]:
            yield BEGIN
            yield from body(env)
            yield END
        return generated
    body = _runs(node.body, filters)

    def loop(env: dict) -> Iterator[Event]:
        rows, i, before = iter(env["messages"]), 0, None
        now = next(rows, None)
        while now is not None:
            after = next(rows, None)
            place = {"index0": i, "index": i + 1, "first": i == 0, "last": after is None, "previous": before, "next": after}
            yield from body(env | {node.name: now, "loop": place})
            yield TURN
            before, now, i = now, after, i + 1
    return loop


def compiled(source: str, filters: dict[str, Callable], names: Iterable[str] = ()) -> Callable[..., Iterator[Event]]:
    """``render(messages, **values)`` of a template: messages are mappings, taken one by one."""
    run = _runs(fold(parse(source, filters, names), filters), filters)
    return lambda messages, **values: run({"messages": messages, **values})
