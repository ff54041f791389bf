"""The query language: text to statements.

    FROM|MATCH entity [SIGUE a..b "label" [TYPE t] [AS x]] [alias] [WHERE c AND c ...] [FETCH f, ...] [RANK BY f [DESC]]
        [WITH TEMPERATURE t] [ROLE "r"]
    SELECT *|f, ... FROM entity [alias] (JOIN entity alias ON f = f)* [WHERE c AND c ...] [WITH TEMPERATURE t]
    INSERT NODE#id TYPE t {k: v, ...} [VECTOR [...]]       UPDATE NODE#id SET k = v, ... | SET VECTOR [...]
    DELETE NODE#id                                         RELATE NODE#a --"label"--> NODE#b [WEIGHT w]
    INSERT MESSAGE SYSTEM|USER|ASSISTANT "text" TO THREAD#id

A condition is ``f op value``, ``f ~ "text", min = s`` or, after SELECT, ``f op (SELECT f FROM ...)``. Values: quoted text, numbers, true,
false, null. Keywords are case-sensitive. ``TIPO`` and ``a-b`` are taken for ``TYPE`` and ``a..b``. What follows a statement is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Near:
    """``field ~ "text", min = s``."""

    field: str
    text: str
    least: float


@dataclass(frozen=True)
class SubqueryCondition:
    field: str
    op: str
    query: Select


@dataclass(frozen=True)
class Walk:
    least: int
    most: int
    label: str
    kind: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class From:
    entity: str
    alias: str | None = None
    walk: Walk | None = None
    where: tuple = ()
    fetch: tuple[str, ...] = ()
    rank_by: str | None = None
    descending: bool = False
    temperature: float | None = None
    role: str | None = None


@dataclass(frozen=True)
class Join:
    entity: str
    alias: str | None
    left: str
    right: str


@dataclass(frozen=True)
class Select:
    fields: tuple[str, ...]
    entity: str
    alias: str | None = None
    joins: tuple[Join, ...] = ()
    where: tuple = ()
    temperature: float | None = None


@dataclass(frozen=True)
class InsertNode:
    id: str
    kind: str
    fields: dict = field(default_factory=dict)
    vector: tuple[float, ...] | None = None


@dataclass(frozen=True)
class UpdateNode:
    id: str
    fields: dict = field(default_factory=dict)
    vector: tuple[float, ...] | None = None


@dataclass(frozen=True)
class DeleteNode:
    id: str


@dataclass(frozen=True)
class Relate:
    src: str
    label: str
    dst: str
    weight: float = 1.0


@dataclass(frozen=True)
class InsertMessage:
    role: str
    text: str
    thread: str


_LEX = re.compile(
    r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<range>\d+(?:\.\.|-)\d+)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<arrow>-->|--)|(?P<name>[A-Za-z_][A-Za-z0-9_#.]*)|(?P<op>!=|>=|<=|[=<>~])|(?P<sign>[(){}\[\],:*]))""",
    re.X,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"'}
KEYWORDS = {"FROM", "MATCH", "SIGUE", "TYPE", "TIPO", "AS", "WHERE", "AND", "FETCH", "RANK", "BY", "DESC", "WITH", "TEMPERATURE", "ROLE", "SELECT", "JOIN", "ON", "SET", "VECTOR", "WEIGHT", "TO"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, i = text, [], 0
        while text[i:].strip():
            m = _LEX.match(text, i)
            if not m:
                self._fail("unexpected character", i + len(text[i:]) - len(text[i:].lstrip()))
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            i = m.end()
        self.i = 0

    def _fail(self, message: str, at: int | None = None):
        if at is None:
            at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        before = self.text[:at]
        raise ParseError(message, before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1)

    def peek(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][1] in values and self.tokens[self.i][0] != "text"

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self._fail(f"expected {value}")

    def one(self, *kinds: str) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] not in kinds:
            self._fail(f"expected {' or '.join(kinds)}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def string(self) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), self.one("text")[1:-1], flags=re.S)

    def name(self) -> str:
        if self.peek(*KEYWORDS):
            self._fail("expected a name")
        return self.one("name")

    def value(self):
        if self.i < len(self.tokens):
            kind, raw, _ = self.tokens[self.i]
            if kind == "text":
                return self.string()
            if kind == "number":
                self.i += 1
                return float(raw) if re.search("[.eE]", raw) else int(raw)
            for word, v in (("true", True), ("false", False), ("null", None)):
                if self.take(word):
                    return v
        self._fail("expected a value")

    def number(self) -> float:
        return float(self.one("number"))

    def vector(self) -> tuple[float, ...]:
        self.need("[")
        out = []
        while not self.take("]"):
            out.append(self.number())
            if not self.peek("]"):
                self.need(",")
        return tuple(out)

    def conditions(self, sub: bool = False) -> tuple:
        out = []
        if self.take("WHERE"):
            while True:
                f = self.name()
                op = self.one("op")
                if op == "~":
                    text = self.string()
                    self.need(",")
                    self.need("min")
                    self.need("=")
                    out.append(Near(f, text, self.number()))
                elif sub and self.take("("):
                    self.need("SELECT")
                    out.append(SubqueryCondition(f, op, self.select()))
                    self.need(")")
                else:
                    out.append(Condition(f, op, self.value()))
                if not self.take("AND"):
                    break
        return tuple(out)

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return tuple(out)

    def alias(self) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "name" and not self.peek(*KEYWORDS):
            return self.name()
        return None

    def temperature(self) -> float | None:
        if self.take("WITH"):
            self.need("TEMPERATURE")
            return self.number()
        return None

    def from_(self) -> From:
        entity = self.one("name", "sign") if self.peek("*") else self.name()
        walk = None
        if self.take("SIGUE"):
            a, b = re.split(r"\.\.|-", self.one("range"))
            label, kind, alias = self.string(), None, None
            if self.take("TYPE", "TIPO"):
                kind = self.name()
            if self.take("AS"):
                alias = self.name()
            walk = Walk(int(a), int(b), label, kind, alias)
        alias = self.alias()
        where = self.conditions()
        fetch = self.names() if self.take("FETCH") else ()
        rank_by, down = None, False
        if self.take("RANK"):
            self.need("BY")
            rank_by = self.name()
            down = self.take("DESC")
        temperature = self.temperature()
        role = self.string() if self.take("ROLE") else None
        return From(entity, alias, walk, where, fetch, rank_by, down, temperature, role)

    def select(self) -> Select:
        fields = ("*",) if self.take("*") else self.names()
        self.need("FROM")
        entity = self.one("sign") if self.peek("*") else self.name()
        alias = self.alias()
        joins = []
        while self.take("JOIN"):
            other = self.name()
            other_alias = self.alias()
            self.need("ON")
            left = self.name()
            self.need("=")
            joins.append(Join(other, other_alias, left, self.name()))
        return Select(fields, entity, alias, tuple(joins), self.conditions(sub=True), self.temperature())

    def node(self, prefix: str = "NODE#") -> str:
        raw = self.one("name")
        if not raw.startswith(prefix) or len(raw) == len(prefix):
            self.i -= 1
            self._fail(f"expected {prefix}id")
        return raw[len(prefix) :]

    def statement(self):
        if self.peek("("):
            self._fail("programs are not supported")
        if self.take("INSERT"):
            if self.take("MESSAGE"):
                role = self.one("name")
                if role not in ("SYSTEM", "USER", "ASSISTANT"):
                    self.i -= 1
                    self._fail("expected SYSTEM, USER or ASSISTANT")
                text = self.string()
                self.need("TO")
                out = InsertMessage(role.lower(), text, self.node("THREAD#"))
            else:
                node = self.node()
                self.need("TYPE")
                kind, fields = self.name(), {}
                self.need("{")
                while not self.take("}"):
                    k = self.name()
                    self.need(":")
                    fields[k] = self._literal()
                    if not self.peek("}"):
                        self.need(",")
                out = InsertNode(node, kind, fields, self.vector() if self.take("VECTOR") else None)
        elif self.take("UPDATE"):
            node = self.node()
            self.need("SET")
            if self.take("VECTOR"):
                out = UpdateNode(node, {}, self.vector())
            else:
                fields = {}
                while True:
                    k = self.name()
                    self.need("=")
                    fields[k] = self._literal()
                    if not self.take(","):
                        break
                out = UpdateNode(node, fields)
        elif self.take("DELETE"):
            out = DeleteNode(self.node())
        elif self.take("RELATE"):
            src = self.node()
            self.need("--")
            label = self.string()
            self.need("-->")
            dst = self.node()
            out = Relate(src, label, dst, self.number() if self.take("WEIGHT") else 1.0)
        elif self.take("SELECT"):
            out = self.select()
        elif self.take("FROM", "MATCH"):
            out = self.from_()
        else:
            self._fail("expected a statement")
        if self.i < len(self.tokens):
            self._fail("unexpected input after the statement")
        return out

    def _literal(self):
        """Numbers in changes are always doubles."""
        v = self.value()
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def parse(text: str):
    return Parser(text).statement()
