"""Chat formatting: a sandboxed template language compiled to Python closures, and its application to conversations.

The language has text, {{ expression }}, {% for name in messages %}, {% if %} / {% elif %} / {% else %}, and
{% generation %}, which marks what a model is to learn. Expressions know strings, names, fields of a message, ==, !=,
and, or, not, + and the filters `escape` and `trim`; there are no calls, attributes or imports, so a template can't
reach Python. Parsing gives a syntax tree; constant parts are folded (literals joined, decided branches cut); each node
then becomes one generator closure, so a conversation is rendered turn by turn and never held whole.

Escaping is reversible: inside a text, a backslash goes behind the first character of each control string, and one more
where backslashes are there already.

Defined cases: null role and null text are empty; turns are ordered by turn (nulls first), ties by role, then text, and
repeated rows are turns of their own; rows with a null conv_id form one conversation; no rows give no output. Columns
beyond conv_id, turn, role and text are not read.

Scale: one shuffle by conv_id and a spillable sort, then conversations stream through the task in parts of about
`part_chars`; a conversation that holds a third of all rows needs one task's time (its digests are sequential by
definition), but not its memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that only the template may write.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"]
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}[OUT] {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}<<ROLE>>{{ m.role | escape }}<</ROLE>>{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)
#: How the template above begins and ends the text of a turn, by role; None: the role is written out before it.
TURNS = [("user", "<s>[INST] ", " [/INST]"), ("assistant", "[OUT] ", "</s>"), ("system", "<<SYS>>", "<</SYS>>"), (None, "<<ROLE>>", "</s>")]

_rests = "|".join(re.escape(x[1:]) for x in CONTROL)
_to_escape = re.compile(rf"([<\[])(\\*)(?={_rests})")
_to_unescape = re.compile(rf"([<\[])\\(\\*)(?={_rests})")


def escape(text: str) -> str:
    return _to_escape.sub(r"\1\2\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _to_unescape.sub(r"\1\2", text) if "\\" in text else text


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Emit:
    value: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: list


@dataclass(frozen=True)
class Choice:
    branches: list  # of (condition or None, body)


@dataclass(frozen=True)
class Generation:
    body: list


_tokens = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[.+|()]))")
_escapes = {"n": "\n", "t": "\t", "\\": "\\", "'": "'"}


class Expression:
    """Recursive descent over one expression; trees are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.parts, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _tokens.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.parts.append(m[1] or m[2] or m[3])
            at = m.end()
        self.parts.append("")

    def take(self, *wanted: str) -> str:
        return self.parts.pop(0) if self.parts[0] in wanted else ""

    def whole(self) -> tuple:
        tree = self.either()
        if self.parts != [""]:
            raise TemplateError(f"unexpected {self.parts[0]!r}")
        return tree

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
        left = self.joined()
        if kind := self.take("==", "!="):
            return (kind, left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.operand()
        while self.take("|"):
            if not (name := self.take("escape", "trim")):
                raise TemplateError(f"unknown filter {self.parts[0]!r}")
            left = (name, left)
        return left

    def operand(self) -> tuple:
        part = self.parts.pop(0)
        if part == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if part[:1] == "'":
            return ("const", re.sub(r"\\(.)", lambda m: _escapes.get(m[1], m[0]), part[1:-1]))
        if not re.match(r"[A-Za-z_]", part) or part in ("and", "or", "not"):
            raise TemplateError(f"unexpected {part!r}")
        if not self.take("."):
            return ("name", part)
        field = self.parts.pop(0)
        if field not in ("role", "text", "first"):
            raise TemplateError(f"unknown field {field!r}")
        return ("field", part, field)


def parse(source: str) -> list:
    """Template text to a syntax tree."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)

    def body(*ends: str) -> tuple[list, str]:
        out: list = []
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{{"):
                out.append(Emit(Expression(piece[2:-2]).whole()))
            elif not piece.startswith("{%"):
                out.append(Text(piece))
            else:
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return out, piece[2:-2].strip()
                if word == "for":
                    if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())):
                        raise TemplateError("a loop goes over messages")
                    out.append(Loop(m[1], body("endfor")[0]))
                elif word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                elif word == "if":
                    branches, condition = [], Expression(rest).whole()
                    while True:
                        inside, end = body("elif", "else", "endif")
                        branches.append((condition, inside))
                        if end == "endif":
                            break
                        condition = Expression(end[4:]).whole() if end.startswith("elif") else ("const", True)
                    out.append(Choice(branches))
                else:
                    raise TemplateError(f"unexpected {piece!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return body()[0]


_pure: dict[str, Callable] = {"or": lambda a, b: a or b, "and": lambda a, b: a and b, "not": lambda a: not a, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "escape": escape, "trim": str.strip}


def fold_value(tree: tuple) -> tuple:
    if tree[0] not in _pure:
        return tree
    parts = [fold_value(x) for x in tree[1:]]
    return ("const", _pure[tree[0]](*[x[1] for x in parts])) if all(x[0] == "const" for x in parts) else (tree[0], *parts)


def fold(nodes: list) -> list:
    """Constant expressions become text, neighbouring texts one text, and decided branches what they lead to."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Text):
            if out and isinstance(out[-1], Text):
                node = Text(out.pop().value + node.value)
            if not node.value:
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Emit):
            value = fold_value(node.value)
            add(Text(str(value[1])) if value[0] == "const" else Emit(value))
        elif isinstance(node, Loop):
            add(Loop(node.name, fold(node.body)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        elif isinstance(node, Choice):
            branches: list = []
            for condition, inside in node.branches:
                condition = fold_value(condition)
                if condition[0] != "const":
                    branches.append((condition, fold(inside)))
                elif condition[1]:
                    branches.append((None, fold(inside)))
                    break
            if branches and branches[0][0] is None:
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(Choice(branches))
        else:
            add(node)
    return out


#: What closures yield: (text, learned?), or None at the end of a turn.
Piece = tuple[str, bool] | None
Render = Callable[[dict, bool], Iterator[Piece]]


def value_closure(tree: tuple) -> Callable[[dict], object]:
    if tree[0] == "const":
        return lambda env, v=tree[1]: v
    if tree[0] == "name":
        return lambda env, n=tree[1]: env[n]
    if tree[0] == "field":
        return lambda env, n=tree[1], k=tree[2]: env[n][k]
    apply, parts = _pure[tree[0]], [value_closure(x) for x in tree[1:]]
    if len(parts) == 1:
        return lambda env, f=parts[0]: apply(f(env))
    return lambda env, f=parts[0], g=parts[1]: apply(f(env), g(env))


def closure(node) -> Render:
    if isinstance(node, Text):
        return lambda env, learned: iter([(node.value, learned)])
    if isinstance(node, Emit):
        value = value_closure(node.value)
        return lambda env, learned: iter([(str(value(env)), learned)])
    if isinstance(node, Generation):
        inside = sequence(node.body)
        return lambda env, learned: inside(env, True)
    if isinstance(node, Choice):
        branches = [(None if c is None else value_closure(c), sequence(b)) for c, b in node.branches]

        def choose(env: dict, learned: bool) -> Iterator[Piece]:
            for condition, inside in branches:
                if condition is None or condition(env):
                    return inside(env, learned)
            return iter(())

        return choose
    body = sequence(node.body)

    def loop(env: dict, learned: bool) -> Iterator[Piece]:
        for k, message in enumerate(env["messages"]):
            yield from body(env | {node.name: message | {"first": k == 0}}, learned)
            yield None

    return loop


def sequence(nodes: list) -> Render:
    parts = [closure(x) for x in nodes]
    if len(parts) == 1:
        return parts[0]

    def run(env: dict, learned: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(env, learned)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """Template text to a function from messages (dicts of role and text) to pieces."""
    run = sequence(fold(parse(source)))
    return lambda messages: run({"messages": messages}, False)


def parts_of(pieces: Iterable[Piece], part_chars: int) -> Iterator[tuple[str, list[dict]]]:
    """Joins pieces to parts that end with a turn: text, and the spans of it that are learned from."""
    texts: list[str] = []
    spans: list[dict] = []
    at = 0
    for piece in pieces:
        if piece is None:
            if at >= part_chars:
                yield "".join(texts), spans
                texts, spans, at = [], [], 0
            continue
        text, learned = piece
        if learned:
            spans.append({"start": at, "end": at + len(text)})
        texts.append(text)
        at += len(text)
    if texts:
        yield "".join(texts), spans


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn that TEMPLATE wrote, unescaped."""
    at = 0
    while at < len(text):
        role, begin, end = next(x for x in TURNS if text.startswith(x[1], at))
        at += len(begin)
        if role is None:
            stop = text.index("<</ROLE>>", at)
            role, at = unescape(text[at:stop]), stop + len("<</ROLE>>")
        stop = text.index(end, at)
        yield role, unescape(text[at:stop])
        at = stop + len(end)


FORMATTED = "conv_id long, part long, text string, loss_spans array<struct<start: long, end: long>>"
_formatted = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[x].to_pylist() for x in names])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = 1 << 16) -> DataFrame:
    """One row per part of a formatted conversation, in order within its task: conv_id, part (from 0), text, and
    loss_spans (code points of the part under the loss mask). The parts of a conversation, joined by part, are it."""
    parse(template)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        waiting: list[dict] = []
        size = 0
        for conv_id, rows in groupby(rows_of(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in rows)
            for k, (text, spans) in enumerate(parts_of(render(messages), part_chars)):
                waiting.append({"conv_id": conv_id, "part": k, "text": text, "loss_spans": spans})
                size += len(text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(waiting, schema=_formatted)
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=_formatted)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(formatted, FORMATTED)


def read_back(formatted: DataFrame, visit: Callable[[int, Iterator[tuple[str, list[dict]]]], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """Applies visit(conv_id, parts) to each conversation of what format_conversations() returned, part by part, in the
    tasks that format it: no second shuffle."""

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for conv_id, rows in groupby(rows_of(batches, "conv_id", "text", "loss_spans"), key=lambda r: r[0]):
            waiting.append(visit(conv_id, ((text, spans) for _, text, spans in rows)))
            if len(waiting) == 10_000:
                yield pa.RecordBatch.from_pylist(waiting, schema=arrow)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=arrow)

    return formatted.mapInArrow(visited, schema)

