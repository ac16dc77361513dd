"""Chat formatting by a template compiler.

A sandboxed template language - text, {{ expression }}, {% if %}, {% for %}, {% generation %} - is parsed into a syntax tree,
constants are folded, and Python closures are made that render a conversation and note which characters of the output stand inside
generation blocks (the loss mask). Expressions have names, fields, strings, numbers, comparisons, and/or/not, + and the filters of
FILTERS; nothing else can be called or reached.

Texts are escaped reversibly: ESCAPE comes before each ESCAPE and before the second character of each control string that occurs in
a text, so that no text can form a control string and every text can be read back.

Defined results: rows go by turn (then role and text, null last); a null text counts as empty, a null role as the empty role; repeated rows are turns of their own;
a null conv_id is a conversation like any other. An empty table formats to nothing. Rows are sorted over range-split tasks, so that a hot conv_id
is spread by turn, and rendered in pieces of at most CHUNK turns (fewer once they reach CHUNK_CHARS characters). A conversation is its pieces in the order of part and piece;
one that lies within a task and a piece is one row. digests() folds the pieces of a conversation in order and holds one at a time: the SHA-256 of
a conversation is one chain, so that this fold (not the rendering) is one task for each conversation. A template that is more than one loop over the messages needs
all turns at once: it is rendered a conversation a row, which has to fit into a task and 2 GB of text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, partitions, table

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|turn|>")
ESCAPE = "\\"
#: A piece ends after so many turns, or so many characters of text.
CHUNK, CHUNK_CHARS = 4096, 1 << 20
#: Characters of a text by which equal turns and roles are split over tasks.
SPLIT_CHARS = 64
#: Every turn is marked by its role and closed, the assistant's text is generated.
TEMPLATE = (
    "{% for m in messages %}<|role|>{{ m.role | escape }}<|turn|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% elif m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}"
)


class TemplateError(ValueError):
    pass


# Syntax tree


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition or None, body)


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _escaper(controls: tuple[str, ...]) -> re.Pattern:
    """Matches the escape character, and the first character of a control string that follows."""
    return re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True))]))


_MARK = _escaper(CONTROL)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: ESCAPE * 2 if m.group() == ESCAPE else m.group() + ESCAPE, text)


_UNMARK = re.compile(rf"{re.escape(ESCAPE)}({re.escape(ESCAPE)})?")


def unescape(text: str) -> str:
    return _UNMARK.sub(lambda m: m.group(1) or "", text)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "+": lambda a, b: a + b, "not": lambda a: not a}
LEX = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z][A-Za-z_0-9]*)|(?P<op>==|!=|<|>|\+|\||\.|\(|\)))")


class _Expr:
    """Recursive descent: or, and, not, comparison, +, filters, fields."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if value in values and kind in ("op", "name"):
            self.at += 1
            return value
        return None

    def whole(self):
        found = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return found

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">"), ("+",))

    def level(self, k: int):
        if k == 2 and self.take("not"):
            return Op("not", (self.level(2),))
        if k == len(self.LEVELS):
            return self.filtered()
        left = self.level(k + 1)
        while op := self.take(*self.LEVELS[k]):
            left = Op(op, (left, self.level(k + 1)))
        return left

    def filtered(self):
        out = self.atom()
        while True:
            if self.take("."):
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a field name is missing")
                self.at += 1
                out = Field(out, name)
            elif self.take("|"):
                _, name = self.peek()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                self.at += 1
                out = Filter(name, out)
            else:
                return out

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(value[1:-1])
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            return Const({"true": True, "false": False}[value]) if value in ("true", "false") else Name(value)
        if value == "(":
            out = self.level(0)
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def body(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Out(_Expr(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                if word == "if":
                    branches, test = [], _Expr(rest).whole()
                    while True:
                        inner, end, rest = body("elif", "else", "endif")
                        branches.append((test, inner))
                        if end == "endif":
                            break
                        test = _Expr(rest).whole() if end == "elif" else None
                    out.append(If(tuple(branches)))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"for {rest!r}")
                    out.append(For(m[1], _Expr(m[2]).whole(), body("endfor")[0]))
                elif word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {{% {word} %}}")
            elif part:
                out.append(Text(part))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), "", ""

    return body()[0]


def fold(node):
    """The tree with constant expressions worked out, constant branches chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in OPS and all(isinstance(a, Const) for a in args):
            return Const(OPS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Out):
        value = fold(node.value)
        return Text(str(value.value)) if isinstance(value, Const) else Out(value)
    if isinstance(node, If):
        kept = []
        for test, inner in node.branches:
            test = None if test is None else fold(test)
            if isinstance(test, Const):
                if not test.value:
                    continue
                test = None
            kept.append((test, fold(inner)))
            if test is None:
                break
        if not kept:
            return ()
        return kept[0][1] if kept[0][0] is None else If(tuple(kept))
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


@dataclass
class Sink:
    parts: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env: node.value
    if isinstance(node, Name):
        return lambda env: env[node.name]
    if isinstance(node, Field):
        of, name = _value(node.of), node.name
        return lambda env: of(env)[name]  # messages are plain dictionaries: no attribute can be reached
    if isinstance(node, Filter):
        of, fn = _value(node.of), FILTERS[node.name]
        return lambda env: fn(of(env))
    a = [_value(x) for x in node.args]
    if node.op == "and":
        return lambda env: a[0](env) and a[1](env)
    if node.op == "or":
        return lambda env: a[0](env) or a[1](env)
    fn = OPS[node.op]
    return (lambda env: fn(a[0](env))) if len(a) == 1 else (lambda env: fn(a[0](env), a[1](env)))


def _closure(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, tuple):
        steps = [_closure(x) for x in node]

        def block(env, sink):
            for step in steps:
                step(env, sink)

        return block
    if isinstance(node, Text):
        return lambda env, sink: sink.put(node.text)
    if isinstance(node, Out):
        value = _value(node.value)
        return lambda env, sink: sink.put(str(value(env)))
    if isinstance(node, If):
        branches = [(_value(t) if t is not None else None, _closure(b)) for t, b in node.branches]

        def choose(env, sink):
            for test, inner in branches:
                if test is None or test(env):
                    return inner(env, sink)

        return choose
    if isinstance(node, For):
        of, inner = _value(node.of), _closure(node.body)

        def loop(env, sink):
            for x in of(env):
                inner({**env, node.name: x}, sink)

        return loop
    inner = _closure(node.body)

    def generated(env, sink):
        start = sink.at
        inner(env, sink)
        sink.spans.append((start, sink.at))

    return generated


def compiled(source: str = TEMPLATE) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages (role, text) -> the rendered text and its generation spans."""
    run = _closure(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        run({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans

    return render


_TURN = re.compile(r"<\|role\|>(.*?)<\|turn\|>(.*?)</s>", re.S)
_WRAP = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>")}


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that TEMPLATE rendered."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("not a rendered conversation")
        at = m.end()
        role, inner = unescape(m[1]), m[2]
        if role in _WRAP:
            a, b = _WRAP[role]
            inner = inner[len(a) : len(inner) - len(b)]
        out.append((role, unescape(inner)))
    if at != len(text):
        raise ValueError("not a rendered conversation")
    return out


def by_turn(source: str) -> bool:
    """Whether the template is one loop over the messages whose body sees a message alone, so that its pieces join up to the whole."""

    def names(node) -> set[str]:
        if isinstance(node, tuple):
            return set().union(*map(names, node))
        if isinstance(node, Name):
            return {node.name}
        return set().union(*(names(getattr(node, f.name)) for f in fields(node))) if is_dataclass(node) else set()

    tree = fold(parse(source))
    return len(tree) == 1 and isinstance(tree[0], For) and tree[0].of == Name("messages") and "messages" not in names(tree[0].body)


PIECES = "conv_id long, part int, piece long, whole boolean, formatted string, spans array<struct<start: long, end: long>>"
PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("whole", pa.bool_()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int | None) -> Iterator[tuple[int, object, int, bool, list[dict]]]:
    """Rows sorted by conv_id and turn -> number of the conversation in this task, conv_id, number of the chunk, whether it is the last here, its turns."""
    nth, key, n, turns, size, any_row = 0, None, 0, [], 0, False
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if any_row and conv != key:
                yield nth, key, n, True, turns
                nth, n, turns, size = nth + 1, 0, [], 0
            elif chunk and (len(turns) >= chunk or size >= CHUNK_CHARS):
                yield nth, key, n, False, turns
                n, turns, size = n + 1, [], 0
            key, any_row = conv, True
            turns.append({"role": role or "", "text": text or ""})
            size += len(turns[-1]["role"]) + len(turns[-1]["text"])
    if any_row:
        yield nth, key, n, True, turns


def _sorted(conversations: DataFrame, spread: bool) -> DataFrame:
    """Rows in order within tasks; spread: also over tasks, else a conversation is in one task."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    turn, role, text = (c.asc_nulls_last() for c in (F.col("turn"), F.col("role"), F.col("text")))
    n = partitions(conversations.sparkSession)
    rows = rows.repartitionByRange(n, "conv_id", turn, role, F.substring("text", 1, SPLIT_CHARS).asc_nulls_last()) if spread else rows.repartition(n, "conv_id")
    return rows.sortWithinPartitions("conv_id", turn, role, text).select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part, piece, whole, formatted, spans: the pieces of each conversation, in order by part and piece; whole if it is the only one for certain.
    Spans (start, end of generated text) count from the start of their piece."""
    spread = by_turn(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, part = compiled(template), TaskContext.get().partitionId()
        held, rows, size = None, [], 0

        def row(nth, key, n, last, turns, inside: bool) -> dict:
            text, spans = render(turns)
            return {"conv_id": key, "part": part, "piece": n, "whole": not spread or (inside and last and not n), "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans]}

        for found in _chunks(batches, chunk if spread else None):
            if held:  # a conversation is inside if others come before and after it in the task
                rows.append(row(*held, held[0] > 0))
                size += len(rows[-1]["formatted"])
                if size >= CHUNK_CHARS or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=PIECE)
                    rows, size = [], 0
            held = found
        if held:
            yield pa.RecordBatch.from_pylist([*rows, row(*held, False)], schema=PIECE)

    return _sorted(in_batches(conversations), spread).mapInArrow(run, PIECES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> the digests of whole conversations; of others what the piece says (said) and its generated text (lost), packed."""
    names, pack = [*(x.split()[0] for x in DIGEST.split(", ")), "part", "piece", "said", "lost"], zstandard.ZstdCompressor(1).compress
    for b in batches:
        rows = []
        for key, part, piece, whole, text, spans in zip(*(b.column(i).to_pylist() for i in range(6))):
            turns = read_back(text)
            loss = "".join([unescape(text[s["start"] : s["end"]]) for s in spans])
            said, lost = "".join([f"{role}\n{said}\n" for role, said in turns]).encode("utf-8", "surrogatepass"), loss.encode("utf-8", "surrogatepass")
            own = (hashlib.sha256(said).hexdigest(), hashlib.sha256(lost).hexdigest(), None, None) if whole else (None, None, pack(said), pack(lost))
            rows.append((key, len(turns), own[0], len(loss), own[1], len(text), part, piece, *own[2:]))
        cols = list(zip(*rows)) if rows else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*_KINDS, pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _read() sorted by conv_id, part, piece -> a row for each conversation."""
    names, unpack = [x.split()[0] for x in DIGEST.split(", ")], zstandard.ZstdDecompressor().decompress
    open_key, sums, hashes = None, None, None

    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=names)

    def closed() -> tuple:
        return open_key, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]

    for b in batches:
        rows = []
        columns = [b.column(i).to_pylist() for i in range(6)]
        for i, (key, turns, sha, loss, _, chars) in enumerate(zip(*columns)):
            if sha is not None:
                rows.append(tuple(c[i] for c in columns))
                continue
            if sums is not None and key != open_key:
                rows.append(closed())
                sums = None
            if sums is None:
                open_key, sums, hashes = key, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
            sums = [x + y for x, y in zip(sums, (turns, loss, chars))]
            for h, packed in zip(hashes, (b.column(8)[i], b.column(9)[i])):
                h.update(unpack(packed.as_py()))
        yield out(rows)
    if sums is not None:
        yield out([closed()])


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says when it is read back, a row for each conversation."""
    read = formatted.mapInArrow(_read, DIGEST + ", part int, piece long, said binary, lost binary")
    return read.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_folded, DIGEST)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_conversations(rows))
