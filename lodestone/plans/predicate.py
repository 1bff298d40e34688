"""The predicate language: text -> tree -> Column.

Grammar (keywords in any letter case, column names exact)::

    or      := and ( OR and )*
    and     := factor ( AND factor )*
    factor  := NOT factor | '(' or ')' | test
    test    := column ( op literal | [NOT-free] IN '(' literal (',' literal)* ')' | LIKE string
                      | BETWEEN literal AND literal | IS [NOT] NULL )
    op      := = | != | < | <= | > | >=
    literal := string in single or double quotes | number | TRUE | FALSE | NULL

Logic has two values. A comparison with a null cell is false, so its negation is true; ``=`` and ``!=`` treat null as a
value. Spark's logic has three, so the compiler pushes negations down to the tests and writes each test in the form
that is right in its place. Those forms are ones that Parquet scans can take as filters (``coalesce`` isn't).
A column that doesn't exist is null everywhere. NOT binds to one factor only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import PredicateError, PredicateTypeError

Literal = str | int | float | bool | None
KEYWORDS = frozenset("AND OR NOT IN LIKE BETWEEN IS NULL TRUE FALSE".split())
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", "'": "'", '"': '"'}
_LEX = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>-?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[(),])|(?P<word>[A-Za-z_][A-Za-z0-9_.]*))""", re.S)


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class In:
    column: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Like:
    column: str
    pattern: str


@dataclass(frozen=True)
class Between:
    column: str
    low: Literal
    high: Literal


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool = False


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class Junction:
    """All (``AND``) or any (``OR``) of the children."""

    op: str
    children: tuple[Node, ...]


Node = Compare | In | Like | Between | IsNull | Not | Junction


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise PredicateError(f"can't read {text[at : at + 20]!r} at {at}")
        kind = m.lastgroup
        out.append((kind, m.group(kind)))
        at = m.end()
    return out


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(0)), s[1:-1], flags=re.S)


class _Parser:
    def __init__(self, text: str) -> None:
        self.all, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.all[self.at] if self.at < len(self.all) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        if kind == "word" and text.upper() in words:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        kind, got = self.next()
        if (got.upper() if kind == "word" else got) != text:
            raise PredicateError(f"expected {text}, found {got or 'the end'!r}")

    def whole(self) -> Node:
        node = self.junction("OR")
        if self.peek()[0] != "end":
            raise PredicateError(f"unexpected {self.peek()[1]!r}")
        return node

    def junction(self, op: str) -> Node:
        part = self.factor if op == "AND" else lambda: self.junction("AND")
        children = [part()]
        while self.word(op):
            children.append(part())
        return children[0] if len(children) == 1 else Junction(op, tuple(children))

    def factor(self) -> Node:
        if self.word("NOT"):
            return Not(self.factor())
        if self.peek() == ("mark", "("):
            self.next()
            node = self.junction("OR")
            self.expect(")")
            return node
        return self.test()

    def test(self) -> Node:
        kind, name = self.next()
        if kind != "word" or name.upper() in KEYWORDS:
            raise PredicateError(f"expected a column, found {name or 'the end'!r}")
        if self.word("IS"):
            negated = self.word("NOT")
            self.expect("NULL")
            return IsNull(name, negated)
        if self.word("IN"):
            self.expect("(")
            values = [self.literal()]
            while self.peek() == ("mark", ","):
                self.next()
                values.append(self.literal())
            self.expect(")")
            return In(name, tuple(values))
        if self.word("LIKE"):
            pattern = self.literal()
            if not isinstance(pattern, str):
                raise PredicateError("LIKE takes a string")
            return Like(name, pattern)
        if self.word("BETWEEN"):
            low = self.literal()
            self.expect("AND")
            return Between(name, low, self.literal())
        kind, op = self.next()
        if kind != "op":
            raise PredicateError(f"expected an operator after {name}, found {op or 'the end'!r}")
        return Compare(name, op, self.literal())

    def literal(self) -> Literal:
        kind, text = self.next()
        if kind == "string":
            return _unquote(text)
        if kind == "number":
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if kind == "word" and text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        raise PredicateError(f"expected a value, found {text or 'the end'!r}")


def parse(text: str) -> Node:
    return _Parser(text).whole()


def _family(kind: T.DataType) -> str:
    return "bool" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else "other"


def _value_family(value: Literal) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"


_OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


class _Compiler:
    def __init__(self, schema: T.StructType) -> None:
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def column(self, name: str) -> Column:
        if name not in self.kinds:
            return F.lit(None).cast("string")
        return F.col("`" + name.replace("`", "``") + "`")

    def same_family(self, name: str, value: Literal) -> bool:
        return name not in self.kinds or _family(self.kinds[name]) == _value_family(value)

    def literal(self, name: str, value: Literal) -> Column:
        return F.lit(value) if name in self.kinds else F.lit(str(value))

    def ordered(self, name: str, op: str, value: Literal) -> None:
        if value is None:
            return
        if not self.same_family(name, value):
            raise PredicateTypeError(f"{name} {op} {value!r}: the column is of type {self.kinds[name].simpleString()}")

    def compile(self, node: Node, negated: bool) -> Column:
        if isinstance(node, Not):
            return self.compile(node.child, not negated)
        if isinstance(node, Junction):
            every = (node.op == "AND") != negated
            out = self.compile(node.children[0], negated)
            for child in node.children[1:]:
                c = self.compile(child, negated)
                out = (out & c) if every else (out | c)
            return out
        return getattr(self, type(node).__name__.lower())(node, negated)

    def isnull(self, node: IsNull, negated: bool) -> Column:
        x = self.column(node.column)
        return x.isNotNull() if node.negated != negated else x.isNull()

    def compare(self, node: Compare, negated: bool) -> Column:
        x, v = self.column(node.column), node.value
        if node.op in ("=", "!="):
            equal = (node.op == "=") != negated
            if v is None:
                return x.isNull() if equal else x.isNotNull()
            if not self.same_family(node.column, v):
                return F.lit(not equal)
            value = self.literal(node.column, v)
            if equal:
                return x.eqNullSafe(value) if negated else x == value
            return ~x.eqNullSafe(value)
        self.ordered(node.column, node.op, v)
        if v is None:
            return F.lit(negated)
        return self.order(x, node.op, self.literal(node.column, v), negated)

    @staticmethod
    def order(x: Column, op: str, value: Column, negated: bool) -> Column:
        ops = {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}
        return x.isNull() | ops[_OPPOSITE[op]] if negated else ops[op]

    def between(self, node: Between, negated: bool) -> Column:
        x = self.column(node.column)
        for v in (node.low, node.high):
            self.ordered(node.column, "BETWEEN", v)
        if node.low is None or node.high is None:
            return F.lit(negated)
        low, high = self.literal(node.column, node.low), self.literal(node.column, node.high)
        return x.isNull() | (x < low) | (x > high) if negated else (x >= low) & (x <= high)

    def in_(self, node: In, negated: bool) -> Column:
        x = self.column(node.column)
        values = [self.literal(node.column, v) for v in node.values if v is not None and self.same_family(node.column, v)]
        null = None in node.values
        some = x.isin(*values) if values else F.lit(False)
        if not negated:
            return some | x.isNull() if null else some
        apart = ~some
        return x.isNotNull() & apart if null else x.isNull() | apart

    def like(self, node: Like, negated: bool) -> Column:
        x = self.column(node.column)
        if self.kinds.get(node.column, T.StringType()) != T.StringType():
            x = x.cast("string")
        test = x.like(node.pattern.replace("\\", "\\\\"))
        return x.isNull() | ~test if negated else test


_Compiler.in_.__name__ = "in"
setattr(_Compiler, "in", _Compiler.in_)


def compile_filter(predicate: str | Node, schema: T.StructType) -> Column:
    """For use as a filter: a null of the result counts as false."""
    return _Compiler(schema).compile(parse(predicate) if isinstance(predicate, str) else predicate, False)


def compile_column(predicate: str | Node, schema: T.StructType) -> Column:
    """For use as a value: true or false, never null."""
    return F.coalesce(compile_filter(predicate, schema), F.lit(False))


def where(df: DataFrame, predicate: str | Node | Callable[[dict], bool], columns: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` for which the predicate holds. A function is called with each row as a dictionary of ``columns``
    (all, if none are named), in Python: a predicate of the language is much faster, and scans can take it."""
    if not callable(predicate):
        return df.where(compile_filter(predicate, df.schema))
    names = df.columns if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(predicate(row)) for row in b.select(names).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def evaluate(node: Node, row: dict) -> bool:
    """The same in plain Python, for one row: the measure for tests."""
    if isinstance(node, Not):
        return not evaluate(node.child, row)
    if isinstance(node, Junction):
        return (all if node.op == "AND" else any)(evaluate(c, row) for c in node.children)
    x = row.get(node.column)
    if isinstance(node, IsNull):
        return (x is None) != node.negated
    same = lambda v: x is None if v is None else x is not None and _value_family(x) == _value_family(v) and x == v
    if isinstance(node, Compare) and node.op in ("=", "!="):
        return same(node.value) == (node.op == "=")
    if isinstance(node, In):
        return any(same(v) for v in node.values)
    if x is None:
        return False
    if isinstance(node, Like):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in node.pattern)
        return re.fullmatch(pattern, str(x), re.S) is not None
    if isinstance(node, Between):
        return node.low is not None and node.high is not None and node.low <= x <= node.high
    v = node.value
    return v is not None and {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[node.op]
