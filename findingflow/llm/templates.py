"""A small sandboxed template language, compiled to Python closures.

    {{ expression | filter }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% for x in xs %}..{% endfor %}   {% generation %}..{% endgeneration %}   {# remark #}

Expressions: strings, numbers, names, ``a.b`` (keys of mappings only), ``not``, ``and``, ``or``, ``==``, ``!=``, ``+``
and parentheses. There are no calls, no attribute or index access to Python objects and no names but those given, so
a template can reach nothing else. The text is parsed into a syntax tree of tuples, constant parts of the tree are
folded, and each node becomes a closure that yields ``(text, is generated)`` pieces. A ``for`` reads its iterable
lazily with one item of lookahead, so a rendering holds one item at a time; after each item it yields a piece whose
text is None, by which a reader can cut the stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
LEXEME = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()]))""", re.S)
Render = Callable[[dict], Iterator[tuple[str, bool]]]


class TemplateError(ValueError):
    pass


class Expression:
    """Parser of one expression to a tree: ("const", v), ("name", n), ("key", e, n), ("not", e), ("filter", e, n), (operator, e, e)."""

    def __init__(self, source: str):
        self.lexemes, at, source = [], 0, source.strip()
        while at < len(source):
            m = LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = m.lastindex
            value = m[kind]
            if kind == 1:
                value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), value[1:-1], flags=re.S)
            self.lexemes.append((("string", "number", "name", "sign")[kind - 1], value))
            at = m.end()

    def next_is(self, *values: str) -> str | None:
        if self.lexemes and self.lexemes[0][0] in ("sign", "name") and self.lexemes[0][1] in values:
            return self.lexemes.pop(0)[1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.lexemes:
            raise TemplateError(f"unexpected {self.lexemes[0][1]!r}")
        return tree

    def chain(self, lower: Callable[[], tuple], *signs: str) -> tuple:
        tree = lower()
        while sign := self.next_is(*signs):
            tree = (sign, tree, lower())
        return tree

    def either(self) -> tuple:
        return self.chain(self.both, "or")

    def both(self) -> tuple:
        return self.chain(self.negated, "and")

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.next_is("not") else self.chain(self.sum, "==", "!=")

    def sum(self) -> tuple:
        return self.chain(self.filtered, "+")

    def filtered(self) -> tuple:
        tree = self.atom()
        while sign := self.next_is(".", "|"):
            if not self.lexemes or self.lexemes[0][0] != "name":
                raise TemplateError(f"a name must follow {sign}")
            tree = ("key" if sign == "." else "filter", tree, self.lexemes.pop(0)[1])
        return tree

    def atom(self) -> tuple:
        if self.next_is("("):
            tree = self.either()
            if not self.next_is(")"):
                raise TemplateError("missing )")
            return tree
        if not self.lexemes:
            raise TemplateError("an expression ends early")
        kind, value = self.lexemes.pop(0)
        if kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        if kind == "name":
            return ("name", value) if value not in ("true", "false", "none") else ("const", {"true": True, "false": False, "none": None}[value])
        return ("const", int(value) if kind == "number" else value)


def parse(source: str) -> tuple:
    """The syntax tree: ("block", [nodes]) of text, output, if, for and generation nodes."""
    parts = [p for p in TAGS.split(source) if p and not p.startswith("{#")]

    def block(*ends: str) -> tuple[tuple, str]:
        nodes = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                nodes.append(("output", Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), f"{word} {rest}".strip()
                nodes.append(statement(word, rest))
            else:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return ("block", nodes), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest}")
            return ("for", m[1], Expression(m[2]).whole(), block("endfor")[0])
        if word == "if":
            cases, otherwise = [], ("block", [])
            while True:
                test = Expression(rest).whole()
                body, end = block("elif", "else", "endif")
                cases.append((test, body))
                word, _, rest = end.partition(" ")
                if word == "else":
                    otherwise, word = block("endif")[0], "endif"
                if word == "endif":
                    return ("if", cases, otherwise)
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


#: What each operator computes, when folded and when run; + joins texts.
OPERATORS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: spelled(a) + spelled(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node: tuple, filters: Mapping[str, Callable]) -> tuple:
    """``node`` with constant expressions computed, constant outputs turned to text, dead branches cut and texts joined."""
    kind = node[0]
    if kind in OPERATORS:
        a, b = fold(node[1], filters), fold(node[2], filters)
        return ("const", OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "not":
        a = fold(node[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        if node[2] not in filters:
            raise TemplateError(f"unknown filter {node[2]!r}")
        a = fold(node[1], filters)
        return ("const", filters[node[2]](a[1])) if a[0] == "const" else ("filter", a, node[2])
    if kind == "key":
        return ("key", fold(node[1], filters), node[2])
    if kind == "output":
        a = fold(node[1], filters)
        return ("text", spelled(a[1])) if a[0] == "const" else ("output", a)
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "if":
        cases = []
        for test, body in node[1]:
            test = fold(test, filters)
            if test[0] != "const":
                cases.append((test, fold(body, filters)))
            elif test[1]:
                return ("if", cases, fold(body, filters)) if cases else fold(body, filters)
        otherwise = fold(node[2], filters)
        return ("if", cases, otherwise) if cases else otherwise
    if kind == "block":
        nodes: list[tuple] = []
        for inner in (fold(n, filters) for n in node[1]):
            for n in inner[1] if inner[0] == "block" else [inner]:
                if n[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + n[1])
                else:
                    nodes.append(n)
        return ("block", nodes)
    return node


def spelled(value: object) -> str:
    return "" if value is None else str(value)


def evaluator(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """The closure that computes an expression in a scope."""
    kind = node[0]
    if kind == "const":
        return lambda scope: node[1]
    if kind == "name":
        return lambda scope: scope.get(node[1])
    inner = evaluator(node[1], filters)
    if kind == "key":

        def key(scope: dict) -> object:
            held = inner(scope)
            return held.get(node[2]) if isinstance(held, Mapping) else None

        return key
    if kind == "not":
        return lambda scope: not inner(scope)
    if kind == "filter":
        apply = filters[node[2]]
        return lambda scope: apply(inner(scope))
    other = evaluator(node[2], filters)
    if kind == "and":
        return lambda scope: inner(scope) and other(scope)
    if kind == "or":
        return lambda scope: inner(scope) or other(scope)
    operator = OPERATORS[kind]
    return lambda scope: operator(inner(scope), other(scope))


def renderer(node: tuple, filters: Mapping[str, Callable]) -> Render:
    """The closure that yields a node's pieces in a scope."""
    kind = node[0]
    if kind == "text":
        piece = (node[1], False)
        return lambda scope: iter((piece,))
    if kind == "output":
        value = evaluator(node[1], filters)
        return lambda scope: iter(((spelled(value(scope)), False),))
    if kind == "block":
        inner = [renderer(n, filters) for n in node[1]]

        def block(scope: dict) -> Iterator[tuple[str, bool]]:
            for r in inner:
                yield from r(scope)

        return block
    if kind == "generation":
        body = renderer(node[1], filters)
        return lambda scope: ((text, text is not None) for text, _ in body(scope))
    if kind == "if":
        cases = [(evaluator(t, filters), renderer(b, filters)) for t, b in node[1]]
        otherwise = renderer(node[2], filters)

        def choose(scope: dict) -> Iterator[tuple[str, bool]]:
            return next((b for t, b in cases if t(scope)), otherwise)(scope)

        return choose
    _, name, many, body = node
    items, each = evaluator(many, filters), renderer(body, filters)

    def loop(scope: dict) -> Iterator[tuple[str, bool]]:
        upcoming = iter(items(scope) or ())
        item = next(upcoming, loop)
        index = 0
        while item is not loop:
            following = next(upcoming, loop)
            index += 1
            yield from each({**scope, name: item, "loop": {"index": index, "first": index == 1, "last": following is loop}})
            yield None, False
            item = following

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Render:
    """A closure from a scope (names to values) to the rendered pieces, each with whether it is generated text."""
    known = {"trim": lambda v: spelled(v).strip(), "upper": lambda v: spelled(v).upper(), "lower": lambda v: spelled(v).lower(), **(filters or {})}
    return renderer(fold(parse(source), known), known)
