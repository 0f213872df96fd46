"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}  {% set x = e %}  {% for m in e %}..{% endfor %}  {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}   marks what a model is trained to produce

Expressions: strings, whole numbers, true/false/none, names, `a.b` and `a['b']` (keys of mappings only), == != in and or not + ~,
and filters `x|name` out of a given table. There are no calls and no attributes of Python objects, so a template reaches only what it
is given. Source -> tokens -> syntax tree (tuples) -> folded tree -> closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.\[\]()+~]))""")
BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
WORDS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("string", "number", "name", "sign"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] in ("name", "sign"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.take("==", "!=", "in"):
            node = (sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = (sign, node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while sign := self.take("|", ".", "["):
            if sign == "[":
                node = ("item", node, self.either())
                if not self.take("]"):
                    raise TemplateError("] is missing")
            else:
                kind, name = self.next()
                if kind != "name":
                    raise TemplateError(f"a name must follow {sign}")
                node = ("filter", node, name) if sign == "|" else ("item", node, ("const", name))
        return node

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self):
        kind, value = self.next()
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return node
        if kind == "sign" or value in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {value!r}")
        return ("const", WORDS[value]) if value in WORDS else ("name", value)


def parse(source: str) -> list:
    """The syntax tree: text, out, set, for, if and generation nodes."""
    pieces, at = [], 0
    for m in BLOCK.finditer(source):
        pieces += [("text", source[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces.append(("text", source[at:]))
    position = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal position
        nodes = []
        while position < len(pieces):
            kind, value = pieces[position]
            position += 1
            if kind == "text":
                if value:
                    nodes.append(("text", value))
                continue
            if kind == "out":
                nodes.append(("out", _Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return nodes, value
            if word == "for":
                if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    raise TemplateError(f"can't read {value!r}")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "set":
                name, _, expression = rest.partition("=")
                nodes.append(("set", name.strip(), _Expression(expression).whole()))
            elif word == "generation":
                nodes.append(("generation", body("endgeneration")[0]))
            elif word == "if":
                nodes.append(branch(rest))
            else:
                raise TemplateError(f"unexpected {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def branch(condition: str):
        yes, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            no = [branch(end[4:])]
        else:
            no = body("endif")[0] if end == "else" else []
        return ("if", _Expression(condition).whole(), yes, no)

    return body()[0]


def _typed(f: Callable) -> Callable:
    """f whose TypeError is the template's."""

    def run(a, b):
        try:
            return f(a, b)
        except TypeError as e:
            raise TemplateError(str(e)) from None

    return run


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _typed(lambda a, b: a in b), "+": _typed(lambda a, b: a + b),
    "~": lambda a, b: _text(a) + _text(b),
}


def _text(value) -> str:
    return "" if value is None else str(value)


def fold(nodes: list, filters: Mapping[str, Callable]) -> list:
    """Constant expressions evaluated, branches on constants decided, neighbouring texts joined."""

    def expression(node):
        kind = node[0]
        if kind in ("const", "name"):
            return node
        if kind == "filter":
            if node[2] not in filters:
                raise TemplateError(f"no filter {node[2]!r}")
            inner = expression(node[1])
            return ("const", filters[node[2]](inner[1])) if inner[0] == "const" else ("filter", inner, node[2])
        inner = [expression(x) for x in node[1:]]
        if kind != "item" and all(x[0] == "const" for x in inner):
            values = [x[1] for x in inner]
            if kind in OPERATIONS:
                return ("const", OPERATIONS[kind](*values))
            return ("const", not values[0] if kind == "not" else values[0] and values[1] if kind == "and" else values[0] or values[1])
        return (kind, *inner)

    out: list = []
    for node in nodes:
        if node[0] == "out":
            node = ("out", expression(node[1]))
            if node[1][0] == "const":
                node = ("text", _text(node[1][1]))
        elif node[0] == "set":
            node = ("set", node[1], expression(node[2]))
        elif node[0] == "for":
            node = ("for", node[1], expression(node[2]), fold(node[3], filters))
        elif node[0] == "generation":
            node = ("generation", fold(node[1], filters))
        elif node[0] == "if":
            condition = expression(node[1])
            if condition[0] == "const":
                out += fold(node[2] if condition[1] else node[3], filters)
                continue
            node = ("if", condition, fold(node[2], filters), fold(node[3], filters))
        out.append(node)
    joined: list = []
    for node in out:
        if node[0] == "text" and joined and joined[-1][0] == "text":
            joined[-1] = ("text", joined[-1][1] + node[1])
        elif node != ("text", ""):
            joined.append(node)
    return joined


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Mapping], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans of code points inside generation marks)."""
    filters = filters or {}

    def expression(node) -> Callable[[dict], object]:
        kind = node[0]
        if kind == "const":
            return lambda env, v=node[1]: v
        if kind == "name":
            return lambda env, n=node[1]: env.get(n)
        if kind == "filter":
            return lambda env, x=expression(node[1]), f=filters[node[2]]: f(x(env))
        a = expression(node[1])
        if kind == "not":
            return lambda env: not a(env)
        b = expression(node[2])
        if kind == "item":
            return lambda env: x.get(b(env)) if isinstance(x := a(env), Mapping) else None
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "or":
            return lambda env: a(env) or b(env)
        return lambda env, f=OPERATIONS[kind]: f(a(env), b(env))

    def block(nodes: list) -> Callable[[dict, list], None]:
        steps = [statement(n) for n in nodes]
        if len(steps) == 1:
            return steps[0]

        def run(env, out):
            for s in steps:
                s(env, out)

        return run

    def statement(node) -> Callable[[dict, list], None]:
        kind = node[0]
        if kind == "text":
            return lambda env, out, t=node[1]: out.append(t)
        if kind == "out":
            return lambda env, out, x=expression(node[1]): out.append(_text(x(env)))
        if kind == "set":
            return lambda env, out, n=node[1], x=expression(node[2]): env.__setitem__(n, x(env))
        if kind == "if":
            condition, yes, no = expression(node[1]), block(node[2]), block(node[3])
            return lambda env, out: (yes if condition(env) else no)(env, out)
        if kind == "generation":
            inner = block(node[1])

            def marked(env, out):
                out.append(None)  # a mark; marks come in pairs
                inner(env, out)
                out.append(None)

            return marked
        name, rows, inner = node[1], expression(node[2]), block(node[3])

        def loop(env, out):
            items: Iterable = rows(env) or ()
            items = list(items)
            for i, item in enumerate(items):
                inner(env | {name: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)

        return loop

    run = block(fold(parse(source), filters))

    def render(variables: Mapping) -> tuple[str, list[tuple[int, int]]]:
        out: list[str | None] = []
        run(dict(variables), out)
        spans, begun, at = [], None, 0
        for piece in out:
            if piece is not None:
                at += len(piece)
            elif begun is None:
                begun = at
            else:
                spans.append((begun, at))
                begun = None
        return "".join([p for p in out if p is not None]), spans

    return render
