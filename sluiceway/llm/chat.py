"""Chat formatting with a small template compiler.

The language: text, ``{{ expression }}``, ``{% for x in e %} .. {% else %} .. {% endfor %}``,
``{% if e %} .. {% elif e %} .. {% else %} .. {% endif %}``, ``{% set name = e %}``,
``{% generation %} .. {% endgeneration %}`` (the text under the loss mask) and ``{# note #}``; a minus
sign inside a mark strips white space on that side. Expressions: strings, integers, true, false, none,
names, ``a.b`` and ``a['b']`` (entries of mappings and lists only), ``not and or == != < > <= >= in + ~``,
parentheses, ``x if c else y`` and filters ``e | name``. It is sandboxed: there are no calls,
no attributes of Python objects and no filters but those listed in FILTERS or given by the caller.

A template is parsed to a syntax tree, constants are folded (a filter on a constant, an ``if`` with a
known answer, neighbouring texts), and the tree becomes nested Python closures.

``format_conversations``: rows are dealt by conversation and sorted by turn; a task renders one conversation
at a time, so memory is that of the longest conversation. Null texts and roles are empty; a null
conversation id is an id of its own; turns that tie are in order of role and text; null turns come last. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluiceway.llm.common import slices

#: What a mark holds: strings, which may hold the mark's end, and other characters.
HELD = r"""((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)"""
MARK = re.compile(rf"\{{\{{(-?){HELD}(-?)\}}\}}|\{{%(-?){HELD}(-?)%\}}|\{{#.*?#\}}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<s>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<n>\d+)|(?P<w>[A-Za-z_]\w*)|(?P<o>==|!=|<=|>=|[<>+~.\[\]()|]))""", re.S)
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "string": lambda x: _text(x),
}


class TemplateError(ValueError):
    pass


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


@dataclass
class Node:
    """kind, its operands and, for constants, the value."""

    kind: str
    args: tuple = ()
    value: object = None


@dataclass
class Out:
    """Text written so far, its length, and the spans under the loss mask."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.size += len(s)


# -- parsing ------------------------------------------------------------------------------------------


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "s" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Node("const")
            return Node("choose", (test, node, other))
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while (op := self.peek()) in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            node = Node(op, (node, self.summed()))
        return node

    def summed(self) -> Node:
        node = self.filtered()
        while (op := self.peek()) in ("+", "~"):
            self.at += 1
            node = Node(op, (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.entry()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "w":
                raise TemplateError("a filter's name expected")
            self.at += 1
            node = Node("filter", (node,), name)
        return node

    def entry(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "w" or name.startswith("_"):
                    raise TemplateError("an entry's name expected")
                self.at += 1
                node = Node("entry", (node, Node("const", (), name)))
            elif self.take("["):
                node = Node("entry", (node, self.choice()))
                self.need("]")
            else:
                return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "s":
            return Node("const", (), re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "n":
            return Node("const", (), int(word))
        if kind == "w" and word in WORDS:
            return Node("const", (), WORDS[word])
        if kind == "w":
            return Node("name", (), word)
        raise TemplateError(f"unexpected {word!r}")


def _no_mark(text: str) -> str:
    """Text between marks; a mark in it has no end, or a string in it has none."""
    if m := re.search(r"\{[{%#]", text):
        raise TemplateError(f"no end of {text[m.start() : m.start() + 20]!r}")
    return text


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(text | print | tag, content), with white space stripped where marks ask for it."""
    at, strip = 0, False
    for m in MARK.finditer(source):
        text = _no_mark(source[at : m.start()])
        text = text.lstrip() if strip else text
        if (m[1] or m[4]) == "-":
            text = text.rstrip()
        yield "text", text
        strip = (m[3] or m[6]) == "-"
        at = m.end()
        if m[2] is not None:
            yield "print", m[2]
        elif m[5] is not None:
            yield "tag", m[5].strip()
    rest = _no_mark(source[at:])
    yield "text", rest.lstrip() if strip else rest


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = list(_pieces(source))
    at = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        nodes: list[Node] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(Node("print", (Node("const", (), content),)))
                continue
            if kind == "print":
                nodes.append(Node("print", (_Expression(content).whole(),)))
                continue
            head, _, rest = content.partition(" ")
            if head in ends:
                return Node("block", tuple(nodes)), content
            if head == "if":
                nodes.append(branch(rest))
            elif head == "for":
                name, word, what = (rest.split(None, 2) + ["", "", ""])[:3]
                if word != "in" or not name.isidentifier():
                    raise TemplateError(f"can't read for {rest!r}")
                body, end = block("endfor", "else")
                other = block("endfor")[0] if end == "else" else Node("block")
                nodes.append(Node("for", (_Expression(what).whole(), body, other), name))
            elif head == "set":
                name, equals, what = rest.partition("=")
                if not equals or not name.strip().isidentifier():
                    raise TemplateError(f"can't read set {rest!r}")
                nodes.append(Node("set", (_Expression(what).whole(),), name.strip()))
            elif head == "generation":
                nodes.append(Node("generation", (block("endgeneration")[0],)))
            else:
                raise TemplateError(f"unknown tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[0]} expected")
        return Node("block", tuple(nodes)), ""

    def branch(test: str) -> Node:
        body, end = block("endif", "elif", "else")
        if end.startswith("elif"):
            return Node("if", (_Expression(test).whole(), body, branch(end.partition(" ")[2])))
        other = block("endif")[0] if end == "else" else Node("block")
        return Node("if", (_Expression(test).whole(), body, other))

    return block()[0]


# -- constants and closures -----------------------------------------------------------------------------


def _entry(x: object, k: object) -> object:
    if isinstance(x, dict):
        return x.get(k)
    if isinstance(x, (list, tuple)) and isinstance(k, int) and -len(x) <= k < len(x):
        return x[k]
    return None


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b if b is not None else False,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "entry": _entry,
}


def fold(node: Node, filters: dict[str, Callable] = FILTERS) -> Node:
    """The tree with constant parts computed, known branches chosen and neighbouring texts joined."""
    args = tuple(fold(x, filters) for x in node.args)
    node = Node(node.kind, args, node.value)
    known = [x.value for x in args] if all(x.kind == "const" for x in args) else None
    if node.kind in OPERATIONS and known is not None:
        return Node("const", (), OPERATIONS[node.kind](*known))
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        if known is not None:
            return Node("const", (), filters[node.value](known[0]))
    if node.kind == "not" and known is not None:
        return Node("const", (), not known[0])
    if node.kind in ("and", "or") and args[0].kind == "const":
        return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
    if node.kind in ("if", "choose") and args[0].kind == "const":
        return args[1] if args[0].value else args[2]
    if node.kind == "block":
        flat: list[Node] = []
        for x in args:
            for y in x.args if x.kind == "block" else (x,):
                if y.kind == "print" and y.args[0].kind == "const":
                    text = _text(y.args[0].value)
                    if flat and flat[-1].kind == "print" and flat[-1].args[0].kind == "const":
                        text = flat.pop().args[0].value + text
                    if text:
                        flat.append(Node("print", (Node("const", (), text),)))
                else:
                    flat.append(y)
        return Node("block", tuple(flat))
    return node


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure from the variables to the expression's value."""
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, k=node.value: env.get(k)
    inner = [_value(x, filters) for x in node.args]
    if node.kind in OPERATIONS:
        return lambda env, f=OPERATIONS[node.kind], a=inner[0], b=inner[1]: f(a(env), b(env))
    if node.kind == "filter":
        return lambda env, f=filters[node.value], a=inner[0]: f(a(env))
    if node.kind == "not":
        return lambda env, a=inner[0]: not a(env)
    if node.kind == "and":
        return lambda env, a=inner[0], b=inner[1]: a(env) and b(env)
    if node.kind == "or":
        return lambda env, a=inner[0], b=inner[1]: a(env) or b(env)
    if node.kind == "choose":
        return lambda env, t=inner[0], a=inner[1], b=inner[2]: a(env) if t(env) else b(env)
    raise TemplateError(f"no value: {node.kind}")


def _writer(node: Node, filters: dict[str, Callable]) -> Callable[[dict, Out], None]:
    """A closure that writes what a statement says."""
    if node.kind == "print":
        if node.args[0].kind == "const":
            return lambda env, out, s=_text(node.args[0].value): out.write(s)
        return lambda env, out, v=_value(node.args[0], filters): out.write(_text(v(env)))
    if node.kind == "block":
        steps = [_writer(x, filters) for x in node.args]

        def run(env: dict, out: Out) -> None:
            for step in steps:
                step(env, out)

        return run
    if node.kind == "set":
        return lambda env, out, k=node.value, v=_value(node.args[0], filters): env.__setitem__(k, v(env))
    if node.kind == "if":
        test, yes, no = _value(node.args[0], filters), _writer(node.args[1], filters), _writer(node.args[2], filters)
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if node.kind == "generation":
        inner = _writer(node.args[0], filters)

        def marked(env: dict, out: Out) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return marked
    if node.kind == "for":
        items, body, other = _value(node.args[0], filters), _writer(node.args[1], filters), _writer(node.args[2], filters)

        def loop(env: dict, out: Out, name: str = node.value) -> None:
            xs = items(env) or []
            for i, x in enumerate(xs):
                body({**env, name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(xs) - 1, "length": len(xs)}}, out)
            if not xs:
                other(env, out)

        return loop
    raise TemplateError(f"not a statement: {node.kind}")


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans under the loss mask)."""
    known = FILTERS | (filters or {})
    write = _writer(fold(parse(source), known), known)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        write(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


# -- the production format ------------------------------------------------------------------------------

#: Strings that mark turns here or in other formats; inside texts they are escaped.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]
START, END = CONTROLS[0], CONTROLS[1]
TEMPLATE = """{%- for m in messages -%}
{{ '<|im_start|>' + (m.role | role) + '\\n' }}
{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{%- else -%}{{ m.text | escape }}{%- endif -%}
{{ '<|im_end|>\\n' }}
{%- endfor -%}"""

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)) + r"|\\")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str | None) -> str:
    """A backslash goes behind the first character of each control string; backslashes double. No control string is left."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str | None) -> str:
    return re.sub(r"[%<\[\n]", lambda m: f"%{ord(m[0]):02X}", role or "")


def unescape_role(role: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) that a formatted conversation says."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """Per conversation: conv id, formatted (the text) and loss_spans (code point ranges under the loss mask)."""
    key_type = rows.schema[conv].dataType.simpleString()
    narrow = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    # null ids are spread by nothing and stay one conversation, as any other id
    dealt = narrow.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_last(), "role", "text")
    arrow_key = to_arrow_type(rows.schema[conv].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape, "role": escape_role})

        def done(key: object, turns: list[dict]) -> pa.RecordBatch:
            formatted, spans = render({"messages": turns})
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([key], arrow_key), pa.array([formatted], pa.string()), pa.array([[{"first": a, "last": b} for a, b in spans]], span)], ["conv", "formatted", "loss_spans"])

        key, turns, ready, size = None, [], [], 0
        for batch in slices(batches):
            for k, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if turns and k != key:
                    ready.append(done(key, turns))
                    size += ready[-1].nbytes
                    turns = []
                    if size > 4_000_000:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready, size = [], 0
                key = k
                turns.append({"role": r or "", "text": t or ""})
        if turns:
            ready.append(done(key, turns))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    schema = f"conv {key_type}, formatted string, loss_spans array<struct<first:bigint,last:bigint>>"
    return dealt.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from its formatted text alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    key_type = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches):
            out = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(t)
                said = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
                loss = "".join(unescape(t[s["first"] : s["last"]]) for s in spans)
                out.append((len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(t)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv {key_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(F.col(conv).alias("conv"), "formatted", "loss_spans").mapInArrow(run, schema).withColumnRenamed("conv", conv)
