"""Chat formatting: a compiler for a small sandboxed template language.

A template is text with ``{{ expression }}`` for output and ``{% statement %}`` for control. Statements: for NAME in
EXPRESSION ... endfor, if EXPRESSION ... elif ... else ... endif, set NAME = EXPRESSION, and generation ... endgeneration,
which marks what the model is to learn. Expressions: strings, whole numbers, true, false, none, names, a.b and a['b']
(keys of dictionaries and nothing else), not, and, or, ==, !=, in, + and ~ (joins texts), and filters, x | name, from FILTERS.
There are no calls, no attributes of Python objects and no loops but over the data, so a template can neither reach
Python nor run on.

Compiling parses the template to a syntax tree, folds what is constant, and makes Python closures of the tree. They give
(text, generated) pieces one by one, so a conversation of any length is rendered in the memory of one of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Marks each turn; texts and roles are escaped, so no text can end a turn or open one.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
# Control strings of the default template: "### ", ":" after a role, "</turn>".
_CONTROL = re.compile(r"[\\#:]|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""Puts \ before every letter that could be part of a control string, and before \ itself."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: What templates may apply to a value.
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower()}


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|[()\[\].|+~]))""", re.DOTALL)
_CONSTANTS = {"true": True, "false": False, "none": None}
_LETTERS = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent from the loosest operator to the tightest; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(next((kind, x) for kind, x in zip(("number", "string", "name", "op"), m.groups(), strict=True) if x is not None))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in wanted

    def take(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def chain(self, lower: Callable, *ops: str):
        node = lower()
        while self.peek(*ops):
            node = ("binary", self.take()[1], node, lower())
        return node

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.chain(self.joined, "==", "!=", "in")

    def joined(self):
        return self.chain(self.filtered, "+", "~")

    def filtered(self):
        node = self.single()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def single(self):
        kind, x = self.take()
        if kind == "number":
            node = ("const", int(x))
        elif kind == "string":
            node = ("const", re.sub(r"\\(.)", lambda m: _LETTERS.get(m[1], m[1]), x[1:-1], flags=re.DOTALL))
        elif kind == "name" and x in _CONSTANTS:
            node = ("const", _CONSTANTS[x])
        elif kind == "name":
            node = ("name", x)
        elif x == "(":
            node = self.either()
            if self.take() != ("op", ")"):
                raise TemplateError("( isn't closed")
        else:
            raise TemplateError(f"unexpected {x!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, key = self.take()
                if kind != "name":
                    raise TemplateError("a name must follow a dot")
                node = ("key", node, ("const", key))
            else:
                node = ("key", node, self.either())
                if self.take() != ("op", "]"):
                    raise TemplateError("[ isn't closed")
        return node


def parse(template: str) -> list:
    """The syntax tree: a list of ("text", t), ("out", e), ("for", name, e, body), ("if", [(e, body), ...]), ("set", name,
    e) and ("generation", body)."""
    body: list = []
    open_blocks: list[tuple[str, list, list]] = []  # end word, the list outside, the if's branches
    at = 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            body.append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("out", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            if not (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                raise TemplateError(f"can't read for {rest!r}")
            inner: list = []
            body.append(("for", f[1], _Expression(f[2]).whole(), inner))
            open_blocks.append(("endfor", body, []))
            body = inner
        elif word == "if":
            branches = [(_Expression(rest).whole(), [])]
            body.append(("if", branches))
            open_blocks.append(("endif", body, branches))
            body = branches[0][1]
        elif word in ("elif", "else"):
            if not open_blocks or open_blocks[-1][0] != "endif":
                raise TemplateError(f"{word} without if")
            open_blocks[-1][2].append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            body = open_blocks[-1][2][-1][1]
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            open_blocks.append(("endgeneration", body, []))
            body = inner
        elif word == "set":
            if not (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.DOTALL)):
                raise TemplateError(f"can't read set {rest!r}")
            body.append(("set", f[1], _Expression(f[2]).whole()))
        elif open_blocks and word == open_blocks[-1][0]:
            body = open_blocks.pop()[1]
        else:
            raise TemplateError(f"unexpected {word!r}")
    if open_blocks:
        raise TemplateError(f"{open_blocks[-1][0]} is missing")
    if at < len(template):
        body.append(("text", template[at:]))
    return body


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


_BINARY = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b), "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b if isinstance(b, (str, list, tuple, dict)) else False,
}


def fold(node):
    """The expression with every constant part computed."""
    kind, *rest = node
    if kind == "binary":
        op, a, b = rest[0], fold(rest[1]), fold(rest[2])
        if a[0] == "const" and op in ("and", "or"):
            return b if bool(a[1]) == (op == "and") else a
        if a[0] == b[0] == "const":
            return ("const", _BINARY[op](a[1], b[1]))
        return ("binary", op, a, b)
    if kind == "not":
        a = fold(rest[0])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(rest[1])
        return ("const", FILTERS[rest[0]](_text(a[1]))) if a[0] == "const" else ("filter", rest[0], a)
    if kind == "key":
        return ("key", fold(rest[0]), fold(rest[1]))
    return node


def fold_body(body: list) -> list:
    """The tree with folded expressions, dead branches gone and neighbouring texts in one."""
    out: list = []
    for node in body:
        kind = node[0]
        if kind == "out":
            e = fold(node[1])
            node = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif kind == "for":
            node = ("for", node[1], fold(node[2]), fold_body(node[3]))
        elif kind == "set":
            node = ("set", node[1], fold(node[2]))
        elif kind == "generation":
            node = ("generation", fold_body(node[1]))
        elif kind == "if":
            branches = []
            for e, inner in node[1]:
                e = fold(e)
                if e[0] == "const" and not e[1]:
                    continue
                branches.append((e, fold_body(inner)))
                if e[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                new = branches[0][1]
            else:
                new = [("if", branches)] if branches else []
            for x in new:
                _append(out, x)
            continue
        _append(out, node)
    return out


def _append(out: list, node) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        node = ("text", out.pop()[1] + node[1])
    if node != ("text", ""):
        out.append(node)


Piece = tuple[str, bool]


def _evaluator(node) -> Callable[[dict], object]:
    kind, *rest = node
    if kind == "const":
        return lambda names, x=rest[0]: x
    if kind == "name":
        return lambda names, x=rest[0]: names.get(x)
    if kind == "key":
        a, b = map(_evaluator, rest)

        def key(names):
            x = a(names)
            return x.get(b(names)) if isinstance(x, dict) else None

        return key
    if kind == "not":
        a = _evaluator(rest[0])
        return lambda names: not a(names)
    if kind == "filter":
        f, a = FILTERS[rest[0]], _evaluator(rest[1])
        return lambda names: f(_text(a(names)))
    op, a, b = rest[0], _evaluator(rest[1]), _evaluator(rest[2])
    if op == "and":
        return lambda names: a(names) and b(names)
    if op == "or":
        return lambda names: a(names) or b(names)
    f = _BINARY[op]
    return lambda names: f(a(names), b(names))


def _renderer(body: list) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = []
    for node in body:
        kind = node[0]
        if kind == "text":

            def step(names, on, x=node[1]):
                yield x, on

        elif kind == "out":

            def step(names, on, e=_evaluator(node[1])):
                yield _text(e(names)), on

        elif kind == "set":

            def step(names, on, name=node[1], e=_evaluator(node[2])):
                names[name] = e(names)
                return iter(())

        elif kind == "generation":

            def step(names, on, inner=_renderer(node[1])):
                return inner(names, True)

        elif kind == "if":

            def step(names, on, branches=[(_evaluator(e), _renderer(x)) for e, x in node[1]]):
                for e, inner in branches:
                    if e(names):
                        yield from inner(names, on)
                        return

        else:

            def step(names, on, name=node[1], e=_evaluator(node[2]), inner=_renderer(node[3])):
                for x in e(names) or ():
                    names[name] = x
                    yield from inner(names, on)

        steps.append(step)

    def render(names: dict, on: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(names, on)

    return render


def compile_template(template: str) -> Callable[..., Iterator[Piece]]:
    """render(**names) gives the (text, generated) pieces; joined texts are the formatted conversation."""
    render = _renderer(fold_body(parse(template)))
    return lambda **names: render(names, False)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, text, generated: the rendered pieces of each conversation of rows (conv_id, turn, role, text, more),
    in order, every conversation in one partition and in order of part.

    Turns are in order of turn, then role, then text; null roles and texts are empty; rows without a conv_id are one
    conversation. Conversations are streamed, so one of any length needs the memory of a turn only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        stream = ((c.as_py(), {"role": r.as_py() or "", "text": t.as_py() or ""}) for b in batches for c, r, t in zip(b.column("conv_id"), b.column("role"), b.column("text"), strict=True))
        held = next(stream, None)
        out: dict[str, list] = {"conv_id": [], "part": [], "text": [], "generated": []}
        size = 0

        def messages(conv_id) -> Iterator[dict]:
            nonlocal held
            while held is not None and held[0] == conv_id:
                message = held[1]
                held = next(stream, None)
                yield message

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), pa.array(out["part"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["generated"], pa.bool_())], list(out))
            for x in out.values():
                x.clear()
            return made

        while held is not None:
            conv_id = held[0]
            turns = messages(conv_id)
            for part, (text, generated) in zip(count(), render(messages=turns)):
                for k, x in zip(out, (conv_id, part, text, generated), strict=True):
                    out[k].append(x)
                size += len(text)
                if size > 1 << 20 or len(out["part"]) >= 4096:
                    yield batch()
                    size = 0
            for _ in turns:  # what the template left unread
                pass
        yield batch()

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part long, text string, generated boolean")


class _TurnReader:
    """Reads the default template's output as it comes: turns, and the text under the generation mask."""

    _END = re.compile(r"\\.|### |:\n|</turn>\n", re.DOTALL)

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.buffer = ""
        self.state = "head"
        self.masked = ""

    def feed(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        if generated:
            own = unescape(text)  # the default template never cuts a piece within an escape
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        self.buffer += text
        at = low = 0
        while m := self._END.search(self.buffer, at):
            at = m.end()
            if self.state == "head" and m[0] == "### ":
                low, self.state = at, "role"
            elif self.state == "role" and m[0] == ":\n":
                self.turns.update(unescape(self.buffer[low : m.start()]).encode() + b"\n")
                low, self.state = at, "text"
            elif self.state == "text" and m[0] == "</turn>\n":
                self.turns.update(unescape(self.buffer[low : m.start()]).encode() + b"\n")
                low, self.state, self.n_turns = at, "head", self.n_turns + 1
        self.buffer = self.buffer[low:]


def read_conversations(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from format_conversations' output with the
    default template alone. parts must be as format_conversations leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv_id, rows = None, None, []

        def row() -> tuple:
            return conv_id, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, part, text, generated in zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "text", "generated")), strict=True):
                if part == 0:
                    if reader:
                        rows.append(row())
                    reader, conv_id = _TurnReader(), c
                reader.feed(text, generated)
            yield batch()
            rows.clear()
        if reader:
            rows.append(row())
        yield batch()

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
