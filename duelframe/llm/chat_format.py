"""Chat formatting with a compiled template.

A template is parsed into a syntax tree, constant parts are folded, and the tree
becomes Python closures that write text and the borders of generated text. The
language has values, filters and tests of its own and nothing of Python's: names
come from the conversation, members are keys of messages, and loops run over
given lists only, so a template can neither reach code nor run without end.

Conversations are written as they stream by, sorted by turn, one turn in memory
at a time. A conversation of more than ``slice_turns`` turns is dealt out in
slices, for which a template with one loop over the messages is cut into what
comes before, in and after the loop; slices are written by tasks of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import join_sized
from duelframe.operators.ordering import running_total
from duelframe.session import ship, spool


class TemplateError(ValueError):
    """A template that cannot be parsed, or a value that it must not use."""


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    sign: str
    value: Any


@dataclass(frozen=True)
class Binary:
    sign: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    value: Any
    name: str
    args: tuple


@dataclass(frozen=True)
class Test:
    value: Any
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generated:
    body: tuple


# ---- values

UNDEFINED = type("Undefined", (), {"__bool__": lambda self: False, "__repr__": lambda self: "undefined"})()


def _text_of(value: Any) -> str:
    if value is UNDEFINED:
        return ""
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return {None: "none", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return str(value)
    raise TemplateError(f"cannot print a {type(value).__name__}")


def _number(value: Any) -> int | float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TemplateError("a number is needed")
    return value


def _add(x: Any, y: Any) -> Any:
    return x + y if isinstance(x, str) and isinstance(y, str) else _number(x) + _number(y)


def _divided(x: Any, y: Any, sign: str) -> Any:
    if _number(y) == 0:
        raise TemplateError("division by zero")
    return _number(x) % y if sign == "%" else _number(x) // y


def _ordered(x: Any, y: Any) -> tuple:
    if isinstance(x, str) and isinstance(y, str):
        return x, y
    return _number(x), _number(y)


def _within(x: Any, y: Any) -> bool:
    if isinstance(y, str):
        return isinstance(x, str) and x in y
    if isinstance(y, (list, tuple, dict)):
        return x in y
    raise TemplateError("'in' needs a text, a list or a mapping")


def _member(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return UNDEFINED


def _size(value: Any) -> int:
    if isinstance(value, (str, list, tuple, dict)):
        return len(value)
    raise TemplateError("length needs a text, a list or a mapping")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": _add, "-": lambda x, y: _number(x) - _number(y), "*": lambda x, y: _number(x) * _number(y),
    "//": lambda x, y: _divided(x, y, "//"), "%": lambda x, y: _divided(x, y, "%"), "~": lambda x, y: _text_of(x) + _text_of(y),
    "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: (p := _ordered(x, y))[0] < p[1],
    "<=": lambda x, y: (p := _ordered(x, y))[0] <= p[1], ">": lambda x, y: (p := _ordered(x, y))[0] > p[1],
    ">=": lambda x, y: (p := _ordered(x, y))[0] >= p[1], "in": _within, "not in": lambda x, y: not _within(x, y),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text_of(v).strip(), "upper": lambda v: _text_of(v).upper(), "lower": lambda v: _text_of(v).lower(),
    "length": _size, "string": _text_of, "first": lambda v: _member(v, 0), "last": lambda v: _member(v, -1),
    "default": lambda v, other="": other if v is UNDEFINED else v,
    "replace": lambda v, old, new: _text_of(v).replace(old, new) if old else _text_of(v),
    "join": lambda v, gap="": gap.join(map(_text_of, v)),
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda v: v is not UNDEFINED, "undefined": lambda v: v is UNDEFINED, "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "mapping": lambda v: isinstance(v, dict), "odd": lambda v: _number(v) % 2 == 1, "even": lambda v: _number(v) % 2 == 0,
}

# ---- parsing

_TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(
    r"\s+|(?P<number>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<sign>//|==|!=|<=|>=|[-+*%~<>()\[\],.|=:])", re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"if", "else", "and", "or", "not", "in", "is", "for", "set"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"unexpected {source[at]!r} in {source!r}")
            if match.lastgroup:
                self.tokens.append((match.lastgroup, match.group()))
            at = match.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else ""

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found and found in wanted:
            self.at += 1
            return found
        return ""

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.peek() not in _RESERVED:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            return Choice(test, value, self.choice() if self.take("else") else Const(UNDEFINED))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Binary("or", value, self.both())
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            value = Binary("and", value, self.negated())
        return value

    def negated(self) -> Any:
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        value = self.summed()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                value = Binary(sign, value, self.summed())
            elif self.peek() == "not" and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                value = Binary("not in", value, self.summed())
            elif self.take("is"):
                wrong = self.take("not")
                name = self.take("none") or self.word()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                value = Unary("not", Test(value, name)) if wrong else Test(value, name)
            else:
                return value

    def summed(self) -> Any:
        value = self.multiplied()
        while sign := self.take("+", "-", "~"):
            value = Binary(sign, value, self.multiplied())
        return value

    def multiplied(self) -> Any:
        value = self.signed()
        while sign := self.take("*", "//", "%"):
            value = Binary(sign, value, self.signed())
        return value

    def signed(self) -> Any:
        return Unary("-", self.signed()) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        value = self.atom()
        while True:
            if self.take("."):
                value = Member(value, Const(self.word()))
            elif self.take("["):
                value = Member(value, self.choice())
                self.need("]")
            elif self.take("|"):
                name, args = self.word(), ()
                if self.take("("):
                    args = self.listed(")")
                value = Filter(value, name, args)
            else:
                return value

    def listed(self, close: str) -> tuple:
        values = []
        while not self.take(close):
            values.append(self.choice())
            if not self.take(","):
                self.need(close)
                break
        return tuple(values)

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(float(text) if "." in text else int(text))
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("["):
            return Filter(Const(None), "list", self.listed("]"))
        if kind == "word" and text in _CONSTANTS:
            self.at += 1
            return Const(_CONSTANTS[text])
        return Name(self.word())


def parse(source: str) -> tuple:
    """Statements of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False

    def plain(text: str, left: bool, right: bool) -> None:
        text = text.lstrip() if left else text
        text = text.rstrip() if right else text
        if text:
            pieces.append(("text", text))

    for tag in _TAG.finditer(source):
        found = tag.group()
        plain(source[at : tag.start()], strip, found[2] == "-")
        strip, at = found[-3] == "-", tag.end()
        if found[1] != "#":
            pieces.append(("print" if found[1] == "{" else "tag", found[2:-2].strip("-").strip()))
    plain(source[at:], strip, False)

    place = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal place
        out: list = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "text":
                out.append(Text(text))
                continue
            if kind == "print":
                made = _Expression(text)
                out.append(Print(made.choice()))
                made.end()
                continue
            word, rest = (*text.split(None, 1), "", "")[:2]
            if word in ends:
                return tuple(out), word, rest
            out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), "", ""

    def condition(rest: str) -> If:
        made = _Expression(rest)
        test = made.choice()
        made.end()
        yes, word, rest = block("elif", "else", "endif")
        if word == "elif":
            return If(test, yes, (condition(rest),))
        return If(test, yes, block("endif")[0] if word == "else" else ())

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            return condition(rest)
        made = _Expression(rest)
        if word == "for":
            name = made.word()
            made.need("in")
            over = made.choice()
            made.end()
            return Loop(name, over, block("endfor")[0])
        if word == "set":
            name = made.word()
            made.need("=")
            value = made.choice()
            made.end()
            return Assign(name, value)
        if word == "generation" and not rest:
            return Generated(block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# ---- folding


def folded(node: Any, filters: dict[str, Callable], names: dict[str, Any]) -> Any:
    """The tree with known names and constant values computed, decided branches chosen and neighbouring texts joined."""
    again = lambda x: folded(x, filters, names)
    if isinstance(node, tuple):
        out: list = []
        for one in map(again, node):
            for part in one if isinstance(one, tuple) else (one,):
                if isinstance(part, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + part.text)
                elif not (isinstance(part, Text) and not part.text):
                    out.append(part)
        return tuple(out)
    if isinstance(node, Name):
        return Const(names[node.name]) if node.name in names else node
    if isinstance(node, (Const, Text)):
        return node
    if isinstance(node, Print):
        value = again(node.value)
        if isinstance(value, Binary) and value.sign == "~":
            return again((Print(value.left), Print(value.right)))
        return Text(_text_of(value.value)) if isinstance(value, Const) else Print(value)
    if isinstance(node, Assign):
        return Assign(node.name, again(node.value))
    if isinstance(node, (If, Choice)):
        test, yes, no = again(node.test), again(node.yes), again(node.no)
        return (yes if test.value else no) if isinstance(test, Const) else type(node)(test, yes, no)
    if isinstance(node, Loop):
        return Loop(node.name, again(node.over), again(node.body))
    if isinstance(node, Generated):
        return Generated(again(node.body))
    if isinstance(node, Member):
        made, inputs = Member(again(node.of), again(node.key)), ("of", "key")
    elif isinstance(node, Unary):
        made, inputs = Unary(node.sign, again(node.value)), ("value",)
    elif isinstance(node, Test):
        made, inputs = Test(again(node.value), node.name), ("value",)
    elif isinstance(node, Filter):
        made, inputs = Filter(again(node.value), node.name, tuple(map(again, node.args))), ("value",)
        if node.name == "list" or not all(isinstance(a, Const) for a in made.args):
            return made
    else:
        made, inputs = Binary(node.sign, again(node.left), again(node.right)), ("left", "right")
    if all(isinstance(getattr(made, i), Const) for i in inputs):
        return Const(_value(made, filters)({}))
    return made


def bound_names(node: Any) -> set[str]:
    """Names that a tree sets itself."""
    if isinstance(node, tuple):
        return set().union(*map(bound_names, node))
    own = {node.name} if isinstance(node, (Assign, Loop)) else set()
    return own.union(*[bound_names(v) for v in getattr(node, "__dict__", {}).values()])


# ---- closures


def _value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    make = lambda x: _value(x, filters)
    if isinstance(node, Const):
        constant = node.value
        return lambda scope: constant
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name, UNDEFINED)
    if isinstance(node, Member):
        of, key = make(node.of), make(node.key)
        if isinstance(node.key, Const) and isinstance(node.key.value, str):
            word = node.key.value
            return lambda scope: v.get(word, UNDEFINED) if type(v := of(scope)) is dict else _member(v, word)
        return lambda scope: _member(of(scope), key(scope))
    if isinstance(node, Unary):
        value = make(node.value)
        return (lambda scope: not value(scope)) if node.sign == "not" else (lambda scope: -_number(value(scope)))
    if isinstance(node, Binary):
        left, right = make(node.left), make(node.right)
        if node.sign == "and":
            return lambda scope: left(scope) and right(scope)
        if node.sign == "or":
            return lambda scope: left(scope) or right(scope)
        work = BINARY[node.sign]
        return lambda scope: work(left(scope), right(scope))
    if isinstance(node, Choice):
        test, yes, no = make(node.test), make(node.yes), make(node.no)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if isinstance(node, Test):
        value, work = make(node.value), TESTS[node.name]
        return lambda scope: work(value(scope))
    if node.name == "list":
        items = list(map(make, node.args))
        return lambda scope: [item(scope) for item in items]
    if node.name not in filters:
        raise TemplateError(f"no filter {node.name!r}")
    value, work, args = make(node.value), filters[node.name], list(map(make, node.args))
    if not args:
        return lambda scope: work(value(scope))
    return lambda scope: work(value(scope), *[arg(scope) for arg in args])


class Output:
    """Text written so far and the borders of generated text, as offsets in code points."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[list[int]] = []
        self.open: int | None = None

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


Write = Callable[[dict, Output], None]


def _statement(node: Any, filters: dict[str, Callable], generating: bool) -> Write:
    if isinstance(node, Text):
        text = node.text
        return lambda scope, out: out.write(text)
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda scope, out: out.write(_text_of(value(scope)))
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value, filters)

        def assign(scope: dict, out: Output) -> None:
            scope[name] = value(scope)

        return assign
    if isinstance(node, If):
        test, yes, no = _value(node.test, filters), _block(node.yes, filters, generating), _block(node.no, filters, generating)
        return lambda scope, out: (yes if test(scope) else no)(scope, out)
    if isinstance(node, Generated):
        if generating:
            raise TemplateError("generation inside generation")
        body = _block(node.body, filters, True)

        def generated(scope: dict, out: Output) -> None:
            start = out.open = out.size
            body(scope, out)
            out.spans.append([start, out.size])
            out.open = None

        return generated
    name, over, body = node.name, _value(node.over, filters), _block(node.body, filters, generating)

    def loop(scope: dict, out: Output) -> None:
        items = over(scope)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("a loop needs a list")
        for at, item in enumerate(items):
            body(turn_scope(scope, name, item, at, at == len(items) - 1), out)

    return loop


def turn_scope(scope: dict, name: str, item: Any, at: int, last: bool) -> dict:
    """Names inside one turn of a loop; what is set there ends with the turn."""
    return {**scope, name: item, "loop": {"index0": at, "index": at + 1, "first": at == 0, "last": last}}


def _block(nodes: tuple, filters: dict[str, Callable], generating: bool = False) -> Write:
    steps = [_statement(node, filters, generating) for node in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def names_in(node: Any) -> set[str]:
    """Names that a part of a tree reads."""
    if isinstance(node, tuple):
        return set().union(*map(names_in, node))
    if isinstance(node, Name):
        return {node.name}
    return set().union(*[names_in(v) for v in getattr(node, "__dict__", {}).values()])


@dataclass
class Compiled:
    """What a template writes before, for each of, and after the messages, as closures."""

    before: Write
    turn: Write
    after: Write
    loop_name: str
    names: dict[str, Any] = field(default_factory=dict)

    def render(self, messages: Iterable[dict], first: int = 0, closes: bool = True, size: int | None = None) -> Iterator[Output]:
        """Output piece by piece for messages that stream by, the first of which is number ``first`` of its conversation.

        ``closes``: the conversation ends with these messages.
        """
        scope, out = dict(self.names), Output()
        if first == 0:
            self.before(scope, out)
        else:  # what was set before the loop holds in every slice; its text is written once
            self.before(scope, Output())
        rows = iter(messages)
        item, at = next(rows, None), first
        while item is not None:
            following = next(rows, None)
            self.turn(turn_scope(scope, self.loop_name, item, at, closes and following is None), out)
            item, at = following, at + 1
            if size is not None and out.size >= size:
                yield out
                out = Output()
        if closes:
            self.after(scope, out)
        yield out


def compile_template(source: str, names: dict[str, Any] | None = None, filters: dict[str, Callable] | None = None) -> Compiled:
    """Closures of a template that walks through ``messages`` once, in one loop at its top."""
    known = {**FILTERS, **(filters or {})}
    tree = parse(source)
    free = {k: v for k, v in (names or {}).items() if k not in bound_names(tree) and k not in ("messages", "loop")}
    tree = folded(tree, known, free)
    loops = [k for k, node in enumerate(tree) if isinstance(node, Loop) and node.over == Name("messages")]
    if len(loops) != 1:
        raise TemplateError("a template needs one loop over messages, outside of other tags")
    at = loops[0]
    if "messages" in names_in(tree[:at] + tree[at + 1 :]) | names_in(tree[at].body):
        raise TemplateError("messages are read by their loop only, as a conversation may be longer than memory")
    return Compiled(
        _block(tree[:at], known), _block(tree[at].body, known), _block(tree[at + 1 :], known), tree[at].name, dict(names or {})
    )


# ---- the template of the corpus

#: Control strings. None begins inside another one, and none holds the escape sign.
MARKS = {
    "bos": "<s>", "eos": "</s>", "user": "[INST]", "user_end": "[/INST]", "system": "<<SYS>>", "system_end": "<</SYS>>",
    "other": "[ROLE]", "other_end": "[/ROLE]",
}
CONTROLS = tuple(MARKS.values())
SIGN = "\\"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")

TEMPLATE = """
{#- turns of the usual roles have marks of their own, any other role is named -#}
{{- bos -}}
{%- for message in messages -%}
  {%- set text = message.text | escape -%}
  {%- if message.role == 'user' -%}
    {{ user ~ ' ' ~ text ~ ' ' ~ user_end }}
  {%- elif message.role == 'assistant' -%}
    {{ ' ' }}{% generation %}{{ text }}{% endgeneration %}{{ ' ' ~ eos }}
  {%- elif message.role == 'system' -%}
    {{ system ~ '\\n' ~ text ~ '\\n' ~ system_end }}
  {%- else -%}
    {{ other ~ (message.role | escape) ~ other_end ~ text ~ eos }}
  {%- endif -%}
{%- endfor -%}
"""


def escaped(text: Any) -> str:
    """Text without control strings: escape signs are doubled, and one is put after the first sign of every control string."""
    text = _text_of(text)
    if SIGN not in text and not _CONTROL.search(text):
        return text
    return _CONTROL.sub(lambda m: m[0][0] + SIGN + m[0][1:], text.replace(SIGN, SIGN * 2))


def unescaped(text: str) -> str:
    """The text that :func:`escaped` was given."""
    return _ESCAPED.sub(r"\1", text) if SIGN in text else text


def corpus_template() -> Compiled:
    return compile_template(TEMPLATE, MARKS, {"escape": escaped})


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of formatted text."""
    at = 0

    def upto(mark: str, start: int) -> tuple[str, int]:
        end = text.find(MARKS[mark], start)
        if end < 0:
            raise ValueError(f"{MARKS[mark]} is missing")
        return text[start:end], end + len(MARKS[mark])

    while at < len(text):
        mark = _CONTROL.match(text, at)
        kind = mark[0] if mark else None
        start = mark.end() if mark else at
        if kind == MARKS["bos"]:
            at = start
            continue
        if kind == MARKS["other"]:
            role, start = upto("other_end", start)
            body, at = upto("eos", start)
            yield unescaped(role), unescaped(body)
            continue
        role = {MARKS["user"]: "user", MARKS["system"]: "system", None: "assistant"}[kind]
        body, at = upto({"user": "user_end", "system": "system_end", "assistant": "eos"}[role], start)
        yield role, unescaped(body[1:-1])


# ---- tables

#: Turns of a slice of a longer conversation, and code points after which a piece of output is given out.
SLICE_TURNS, PIECE_CHARS = 65_536, 500_000


def _sliced(rows: DataFrame, slice_turns: int) -> tuple[DataFrame, bool]:
    """Rows with the slice of their conversation, the turns before it, and whether it is the last; and whether any is cut."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("turns")).where(F.col("turns") > slice_turns)
    long = spool(counts, "long-conversations")
    if long.isEmpty():
        return rows.withColumns({"slice": F.lit(0), "before": F.lit(0).cast("long"), "closes": F.lit(True)}), False
    # turns of long conversations, counted: rows with the same turn stay together
    held = join_sized(rows.select("key", "at"), long.select("key"), ["key"]).groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(held, ["at"], {"before": "n"}, ["key"])
    cuts = placed.groupBy("key", F.floor(F.col("before") / slice_turns).alias("part")).agg(
        F.min("at").alias("from"), F.min("before").alias("before")
    )
    # a conversation has one entry for every slice_turns turns
    bounds = spool(cuts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "before"))).alias("bounds")), "slices")
    found = join_sized(rows, bounds, ["key"], "left")
    number = F.coalesce(F.size(F.filter("bounds", lambda b: b["from"] <= F.col("at"))) - 1, F.lit(0))
    found = found.withColumn("slice", F.when(F.col("bounds").isNull(), 0).otherwise(number))
    return found.withColumns({
        "before": F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(F.get("bounds", "slice")["before"]).cast("long"),
        "closes": F.col("bounds").isNull() | (F.col("slice") == F.size("bounds") - 1),
    }).drop("bounds"), True


def format_conversations(
    conversations: DataFrame, template: Callable[[], Compiled] = corpus_template, id_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", slice_turns: int = SLICE_TURNS, piece_chars: int = PIECE_CHARS,
) -> tuple[DataFrame, bool]:
    """Formatted conversations piece by piece, and whether long ones were cut into slices.

    Rows: (key, id, slice, piece, text, spans), where ``spans`` are (from, to) of
    generated text in the piece, in code points. Pieces end between turns, and in
    the order of slice and piece they are the conversation's text. Turns stand in
    the order of their numbers, null ones last, then of role and text, so the
    order of rows does not matter; repeated rows are turns of their own. A null
    text or role is empty; rows without an id are one conversation. An empty
    table gives no rows, other columns are not read. One turn is held in memory,
    however long it is.
    """
    ship(__name__)
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit("")).alias("key"), F.col(id_column).alias("id"),
        F.coalesce(F.col(turn_column).cast("long"), F.lit(2**63 - 1)).alias("at"),
        F.coalesce(role_column, F.lit("")).alias("role"), F.coalesce(text_column, F.lit("")).alias("text"),
    )
    rows, cut = _sliced(rows, slice_turns)
    ordered = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "at", "role", "text")
    kind = conversations.schema[id_column].dataType.simpleString()
    out = f"key string, id {kind}, slice int, piece int, text string, spans array<struct<start:int,end:int>>"

    kinds = (pa.string(), None, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, source, done, size = template(), _Turns(batches), [], 0

        def given() -> pa.RecordBatch:
            arrays = [pa.array(c, type=t or source.id_type) for c, t in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "slice", "piece", "text", "spans"])

        while (head := source.begin()) is not None:
            key, name, part, before, closes = head
            for number, piece in enumerate(compiled.render(source.messages(), before, closes, piece_chars)):
                done.append((key, name, part, number, "".join(piece.parts), [{"start": s, "end": e} for s, e in piece.spans]))
                size += piece.size
                if size >= piece_chars:
                    yield given()
                    size = 0
        if done:
            yield given()

    return ordered.select("key", "id", "slice", "before", "closes", "role", "text").mapInArrow(write, out), cut


class _Turns:
    """Sorted rows as conversations, one after the other; a row is taken from its batch when it is needed."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.id_type = None
        self._rows = self._all(batches)
        self._next = next(self._rows, None)

    def _all(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            self.id_type = batch.schema.field(1).type
            heads = zip(*(batch.column(k).to_pylist() for k in range(6)))
            for head, text in zip(heads, batch.column(6)):
                yield (*head, text.as_py())

    def begin(self) -> tuple | None:
        """(key, id, slice, turns before, is last) of the next slice."""
        return self._next[:5] if self._next else None

    def messages(self) -> Iterator[dict]:
        key, part = self._next[0], self._next[2]
        while self._next and self._next[0] == key and self._next[2] == part:
            yield {"role": self._next[5], "text": self._next[6]}
            self._next = next(self._rows, None)


def read_back(pieces: DataFrame, cut: bool) -> DataFrame:
    """Per conversation what its formatted text gives back: (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    ``cut``: slices of one conversation may lie in several tasks; then the pieces
    are brought together by conversation, in order, and stream through one task
    each, as a digest is a chain over its whole text.
    """
    ship(__name__)
    if cut:
        pieces = pieces.repartition("key").sortWithinPartitions("key", "slice", "piece")
    kind = pieces.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, name, id_type = None, None, None
        turns = chars = loss_chars = 0
        whole = loss = None

        def given() -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, type=t) for c, t in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(
                arrays, names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

        def close() -> None:
            if whole is not None:
                done.append((name, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            id_type = batch.schema.field(1).type
            for own, own_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), batch.column(5).to_pylist()):
                if own != key or whole is None:
                    close()
                    key, name, turns, chars, loss_chars = own, own_id, 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                text = text.as_py()
                chars += len(text)
                for role, body in read_turns(text):
                    turns += 1
                    whole.update(f"{role}\n{body}\n".encode())
                for span in spans:
                    body = unescaped(text[span["start"] : span["end"]])
                    loss_chars += len(body)
                    loss.update(body.encode())
                if len(done) >= 1000:
                    yield given()
        close()
        if done:
            yield given()

    return pieces.select("key", "id", "slice", "piece", "text", "spans").mapInArrow(read, out)
