"""A small sandboxed template language for conversations, compiled to Python closures.

    {% for message in messages %} ... {% endfor %}     once, around the part that repeats
    {% if EXPR %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}           text that a model is to learn
    {{ EXPR }}

An expression has string literals, message.role, message.content, loop.first, loop.index, `~` (concatenation),
==, !=, not, and, or, parentheses and the filters |escape, |trim, |upper, |lower. There is nothing else to reach:
no attributes, calls, subscripts or names besides these. parse() gives the syntax tree, fold() folds
constants in it, compile_template() makes closures of it.

Control strings inside texts are escaped with a backslash before them (and before backslashes), so that
unescape() gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: strings that have a meaning in formatted conversations
CONTROL = ("\\", "###", "</turn>", ": ", "\n")
#: control strings of a text; a role, which stands in a header line, also escapes ": " and line ends
IN_TEXT, IN_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|: |\n")
ESCAPED = re.compile(r"\\(\\|###|</turn>|: |\n)")

DEFAULT = (
    "{% for message in messages %}### {{ message.role|escape_role }}: {% if message.role == 'assistant' %}"
    "{% generation %}{{ message.content|escape }}{% endgeneration %}{% else %}{{ message.content|escape }}{% endif %}</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    return IN_TEXT.sub(lambda m: "\\" + m[0], text)


def escape_role(text: str) -> str:
    return IN_ROLE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}
NAMES = ("message.role", "message.content", "loop.first", "loop.index")
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][\w.]*)|(==|!=|~|\||\(|\)))")


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        if not (m := TOKEN.match(source, at)):
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append(("string", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1])) if m[1] is not None else ("name", m[2]) if m[2] else ("mark", m[3]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, concatenation, filters, atoms."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {source!r}")

    def take(self, *kinds: tuple[str, str]) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in kinds:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        left = self.both()
        while self.take(("name", "or")):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take(("name", "and")):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self):
        left = self.joined()
        if op := self.take(("mark", "=="), ("mark", "!=")):
            return (op, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while self.take(("mark", "~")):
            left = ("~", left, self.filtered())
        return left

    def filtered(self):
        left = self.atom()
        while self.take(("mark", "|")):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "nothing")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            left = ("filter", name, left)
        return left

    def atom(self):
        if self.take(("mark", "(")):
            inner = self.either()
            if not self.take(("mark", ")")):
                raise TemplateError("a parenthesis is not closed")
            return inner
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("const", value)
        if kind == "name" and value in NAMES:
            return ("name", value)
        raise TemplateError(f"no such name: {value!r}")


def parse(source: str) -> list:
    """The syntax tree: a list of (kind, ...) nodes; bodies are lists again."""
    parts = re.split(r"(\{%.*?%\}|\{\{.*?\}\})", source, flags=re.S)
    stack: list[tuple[str, list]] = [("", [])]
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(("out", _Expression(part[2:-2]).tree))
        elif part.startswith("{%"):
            word = part[2:-2].strip()
            if word == "for message in messages":
                body.append(("for", inner := []))
                stack.append(("endfor", inner))
            elif word.startswith("if "):
                body.append(("if", _Expression(word[3:]).tree, inner := [], []))
                stack.append(("endif", inner))
            elif word == "else" and stack[-1][0] == "endif":
                stack[-1] = ("endif", stack[-2][1][-1][3])
            elif word == "generation":
                body.append(("generation", inner := []))
                stack.append(("endgeneration", inner))
            elif word == stack[-1][0]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected tag {word!r}")
        elif part:
            body.append(("out", ("const", part)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is missing")
    return stack[0][1]


def fold_expression(e):
    if e[0] in ("const", "name"):
        return e
    if e[0] == "filter":
        inner = fold_expression(e[2])
        return ("const", FILTERS[e[1]](str(inner[1]))) if inner[0] == "const" else ("filter", e[1], inner)
    own = (e[0], *map(fold_expression, e[1:]))
    return ("const", _value(own)(None, None)) if all(x[0] == "const" for x in own[1:]) else own


def fold(body: list) -> list:
    """The same tree with constant expressions computed, constant branches chosen and neighbouring constants joined."""
    out: list = []
    for node in body:
        if node[0] == "out":
            e = fold_expression(node[1])
            if e[0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
                out[-1] = ("out", ("const", str(out[-1][1][1]) + str(e[1])))
            else:
                out.append(("out", e))
        elif node[0] == "if":
            e = fold_expression(node[1])
            if e[0] == "const":
                out += fold(node[2] if e[1] else node[3])
            else:
                out.append(("if", e, fold(node[2]), fold(node[3])))
        else:
            out.append((node[0], fold(node[1])))
    return out


def _value(e) -> Callable:
    """A closure of (message, loop)."""
    kind = e[0]
    if kind == "const":
        return lambda message, loop, v=e[1]: v
    if kind == "name":
        owner, _, field = e[1].partition(".")
        return (lambda message, loop: message[field]) if owner == "message" else (lambda message, loop: loop[field])
    if kind == "filter":
        f, inner = FILTERS[e[1]], _value(e[2])
        return lambda message, loop: f(str(inner(message, loop)))
    if kind == "not":
        inner = _value(e[1])
        return lambda message, loop: not inner(message, loop)
    a, b = _value(e[1]), _value(e[2])
    return {
        "or": lambda message, loop: a(message, loop) or b(message, loop),
        "and": lambda message, loop: a(message, loop) and b(message, loop),
        "==": lambda message, loop: a(message, loop) == b(message, loop),
        "!=": lambda message, loop: a(message, loop) != b(message, loop),
        "~": lambda message, loop: str(a(message, loop)) + str(b(message, loop)),
    }[kind]


def _run(body: list, learned: bool) -> Callable:
    """A closure of (message, loop, out) that appends (text, learned) to out."""
    steps = []
    for node in body:
        if node[0] == "out":
            steps.append(lambda message, loop, out, f=_value(node[1]): out.append((str(f(message, loop)), learned)))
        elif node[0] == "if":
            yes, no, test = _run(node[2], learned), _run(node[3], learned), _value(node[1])
            steps.append(lambda message, loop, out, t=test, a=yes, b=no: (a if t(message, loop) else b)(message, loop, out))
        elif node[0] == "generation":
            steps.append(_run(node[1], True))
        else:
            raise TemplateError("loops don't nest")

    def run(message, loop, out):
        for step in steps:
            step(message, loop, out)

    return run


class Program:
    """before, each and after render the parts of a conversation to lists of (text, learned)."""

    def __init__(self, source: str):
        tree = fold(parse(source))
        loops = [i for i, node in enumerate(tree) if node[0] == "for"]
        if len(loops) != 1:
            raise TemplateError("there must be one loop over messages")
        self._before, self._each, self._after = _run(tree[: loops[0]], False), _run(tree[loops[0]][1], False), _run(tree[loops[0] + 1 :], False)

    @staticmethod
    def _render(part: Callable, message: dict | None, loop: dict | None) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        part(message, loop, out)
        return out

    def before(self) -> list[tuple[str, bool]]:
        return self._render(self._before, {"role": "", "content": ""}, {"first": True, "index": 0})

    def each(self, role: str, content: str, index: int) -> list[tuple[str, bool]]:
        return self._render(self._each, {"role": role, "content": content}, {"first": index == 0, "index": index})

    def after(self) -> list[tuple[str, bool]]:
        return self._render(self._after, {"role": "", "content": ""}, {"first": False, "index": 0})

    def render(self, messages: Iterable[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
        yield from self.before()
        for i, (role, content) in enumerate(messages):
            yield from self.each(role, content, i)
        yield from self.after()


def compile_template(source: str) -> Program:
    return Program(source)


#: A turn of the default template: its header and its text up to the first </turn> that isn't escaped.
TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|: |\n)|:(?! ))*): ([^\\<]*(?:(?:\\(?:\\|###|</turn>)|<(?!/turn>))[^\\<]*)*)</turn>\n")
