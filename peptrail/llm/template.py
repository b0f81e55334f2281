"""A sandboxed template language for conversations: parser, constant folding, closures.

Text outside tags stands for itself. `{{ expression }}` prints; `{% if %}`, `{% elif %}`,
`{% else %}`, `{% endif %}`, `{% for name in expression %}`, `{% endfor %}`, `{% set name = expression %}`,
`{% generation %}` and `{% endgeneration %}` control; `{# ... #}` is left out. Expressions have
literals, names, `x.key` and `x['key']` (keys of mappings only), `+`, `~`, `==`, `!=`, `and`, `or`, `not`,
`a if c else b`, parentheses and filters `x | name`. A loop offers `loop.index0`, `loop.index`,
`loop.first` and `loop.last`. There are no calls, attributes of Python objects, or imports, so a
template can't reach anything but what it is given.

compile_template() gives a function that renders lazily: it yields (text, generated) pieces, where
`generated` marks text between `generation` tags, and reads its iterables one item ahead only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

Piece = tuple[str, bool]
TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.\[\]()+~|]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable[[object], object]] = {
    "trim": lambda x: show(x).strip(),
    "upper": lambda x: show(x).upper(),
    "lower": lambda x: show(x).lower(),
    "length": lambda x: len(show(x)),
}


class TemplateError(ValueError):
    pass


def show(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


class Expressions:
    """Parses one expression to nested tuples: ('const', v), ('name', n), ('get', x, key), (operator, ...)."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()

    def take(self, *wanted: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "const" and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def whole(self) -> tuple:
        tree = self.choice()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def choice(self) -> tuple:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("choice", test, value, self.choice())
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.added()
        while sign := self.take("==", "!="):
            left = (sign, left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while sign := self.take("+", "~"):
            left = (sign, left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.item()
        while True:
            if self.take("|"):
                value = ("filter", value, self.name())
            elif self.take("."):
                value = ("get", value, self.name())
            elif self.take("["):
                if not self.tokens or self.tokens[0][0] != "const":
                    raise TemplateError("a key must be a literal")
                value = ("get", value, self.tokens.pop(0)[1])
                self.need("]")
            else:
                return value

    def name(self) -> str:
        if not self.tokens or self.tokens[0][0] != "name":
            raise TemplateError("expected a name")
        return self.tokens.pop(0)[1]

    def item(self) -> tuple:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if not self.tokens or self.tokens[0][0] == "sign":
            raise TemplateError("expected a value")
        kind, value = self.tokens.pop(0)
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name" and value.startswith("_"):
            raise TemplateError(f"{value!r} isn't allowed")
        return (kind, value)


def parse(source: str) -> list:
    """The template's syntax tree: ('text', s), ('print', e), ('set', n, e), ('if', [(e, body)...]), ('for', n, e, body), ('generation', body)."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, [])]
    at = 0
    for m in [*TAG.finditer(source), None]:
        body = stack[-1][1]
        if text := source[at : m.start() if m else len(source)]:
            body.append(("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            body.append(("print", Expressions(m[1]).whole()))
        elif m[2] is not None:
            control(m[2].strip(), stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} has no end")
    return root


def control(tag: str, stack: list[tuple[str, list, list]]) -> None:
    word, _, rest = tag.partition(" ")
    top, body, parts = stack[-1]
    inner: list = []
    if word == "if":
        parts = [(Expressions(rest).whole(), inner)]
        body.append(("if", parts))
        stack.append(("if", inner, parts))
    elif word in ("elif", "else") and top == "if":
        parts.append((Expressions(rest).whole() if word == "elif" else ("const", True), inner))
        stack[-1] = ("if", inner, parts)
    elif word == "for":
        if not (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
            raise TemplateError(f"bad loop {tag!r}")
        body.append(("for", m[1], Expressions(m[2]).whole(), inner))
        stack.append(("for", inner, []))
    elif word == "generation" and not rest:
        body.append(("generation", inner))
        stack.append(("generation", inner, []))
    elif word == "set":
        if not (m := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)):
            raise TemplateError(f"bad assignment {tag!r}")
        body.append(("set", m[1], Expressions(m[2]).whole()))
    elif word == "end" + top and top and not rest:
        stack.pop()
    else:
        raise TemplateError(f"unexpected tag {tag!r}")


def fold(tree: tuple, filters: Mapping) -> tuple:
    """The expression with its constant parts evaluated."""
    if tree[0] in ("const", "name"):
        return tree
    if tree[0] == "filter" and tree[2] not in filters:
        raise TemplateError(f"no filter {tree[2]!r}")
    parts = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in tree)
    inner = [x for x in parts[1:] if isinstance(x, tuple)]
    if tree[0] == "choice" and parts[1][0] == "const":
        return parts[2] if parts[1][1] else parts[3]
    if tree[0] != "get" and all(x[0] == "const" for x in inner):
        return ("const", closure(parts, filters)({}))
    return parts


def fold_body(body: list, filters: Mapping) -> list:
    """Nodes with folded expressions, decided branches taken and neighbouring texts joined."""
    out: list = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "print":
            e = fold(node[1], filters)
            add(("text", show(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2], filters)))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2], filters), fold_body(node[3], filters)))
        elif node[0] == "generation":
            add(("generation", fold_body(node[1], filters)))
        elif node[0] == "if":
            kept = []
            for test, inner in node[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                kept.append((test, fold_body(inner, filters)))
                if test[0] == "const":
                    break
            if kept and kept[0][0][0] == "const":
                for n in kept[0][1]:
                    add(n)
            elif kept:
                add(("if", kept))
        else:
            add(node)
    return out


def closure(tree: tuple, filters: Mapping) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "get":
        x, key = closure(tree[1], filters), tree[2]

        def get(env):
            value = x(env)
            return value.get(key) if isinstance(value, dict) else None

        return get
    if kind == "filter":
        x, f = closure(tree[1], filters), filters[tree[2]]
        return lambda env: f(x(env))
    parts = [closure(p, filters) for p in tree[1:]]
    if kind == "choice":
        test, yes, no = parts
        return lambda env: yes(env) if test(env) else no(env)
    if kind == "not":
        return lambda env, a=parts[0]: not a(env)
    a, b = parts
    if kind == "+":

        def plus(env):
            x, y = a(env), b(env)
            return x + y if isinstance(x, int) and isinstance(y, int) else show(x) + show(y)

        return plus
    return {"or": lambda env: a(env) or b(env), "and": lambda env: a(env) and b(env), "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "~": lambda env: show(a(env)) + show(b(env))}[kind]


Renderer = Callable[[dict, bool], Iterator[Piece]]


def renderer(body: list, filters: Mapping) -> Renderer:
    steps = [step(node, filters) for node in body]

    def run(env: dict, generated: bool) -> Iterator[Piece]:
        for s in steps:
            yield from s(env, generated)

    return run


def step(node: tuple, filters: Mapping) -> Renderer:
    kind = node[0]
    if kind == "text":
        return lambda env, g, s=node[1]: iter(((s, g),))
    if kind == "print":
        e = closure(node[1], filters)
        return lambda env, g: iter(((show(e(env)), g),))
    if kind == "set":
        name, e = node[1], closure(node[2], filters)

        def assign(env, g):
            env[name] = e(env)
            return iter(())

        return assign
    if kind == "generation":
        inner = renderer(node[1], filters)
        return lambda env, g: inner(env, True)
    if kind == "if":
        branches = [(closure(t, filters), renderer(b, filters)) for t, b in node[1]]

        def choose(env, g):
            for test, inner in branches:
                if test(env):
                    yield from inner(env, g)
                    return

        return choose
    name, items, inner = node[1], closure(node[2], filters), renderer(node[3], filters)

    def loop(env, g):
        source, nothing, i = iter(items(env) or ()), object(), 0
        item = next(source, nothing)
        while item is not nothing:
            ahead = next(source, nothing)
            scope = {**env, name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": ahead is nothing}}
            yield from inner(scope, g)
            item, i = ahead, i + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """render(**variables) -> pieces (text, generated)."""
    known = FILTERS | dict(filters or {})
    run = renderer(fold_body(parse(source), known), known)

    def render(**variables: Iterable | str) -> Iterator[Piece]:
        return run(dict(variables), False)

    return render
