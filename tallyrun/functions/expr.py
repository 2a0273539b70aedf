"""The expression language: Python operators or text, compiled to Spark columns.

Rules that differ from Spark's: integer arithmetic saturates; integer division truncates and gives null by
zero; a comparison with NaN is false; `x == null` asks whether x is null; a cast that fails gives null.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import OF_CAST, is_nan, millis

MAX_DEPTH = 512
I64_MAX, I64_MIN = (1 << 63) - 1, -(1 << 63)
COMPARISONS = (">", ">=", "<", "<=", "==", "!=")


class ExprError(ValueError):
    """An expression that does not parse or whose types do not fit."""


class Expr:
    def __add__(self, o):
        return Binary("+", self, wrap(o))

    def __radd__(self, o):
        return Binary("+", wrap(o), self)

    def __sub__(self, o):
        return Binary("-", self, wrap(o))

    def __rsub__(self, o):
        return Binary("-", wrap(o), self)

    def __mul__(self, o):
        return Binary("*", self, wrap(o))

    def __rmul__(self, o):
        return Binary("*", wrap(o), self)

    def __truediv__(self, o):
        return Binary("/", self, wrap(o))

    def __rtruediv__(self, o):
        return Binary("/", wrap(o), self)

    def __gt__(self, o):
        return Binary(">", self, wrap(o))

    def __ge__(self, o):
        return Binary(">=", self, wrap(o))

    def __lt__(self, o):
        return Binary("<", self, wrap(o))

    def __le__(self, o):
        return Binary("<=", self, wrap(o))

    def __eq__(self, o):  # type: ignore[override]
        return null_test(Binary("==", self, wrap(o)))

    def __ne__(self, o):  # type: ignore[override]
        return null_test(Binary("!=", self, wrap(o)))

    def __and__(self, o):
        return Binary("and", self, wrap(o))

    def __rand__(self, o):
        return Binary("and", wrap(o), self)

    def __or__(self, o):
        return Binary("or", self, wrap(o))

    def __ror__(self, o):
        return Binary("or", wrap(o), self)

    def __invert__(self):
        return Not(self)

    __hash__ = object.__hash__

    def __bool__(self):
        raise TypeError("use & | ~ to combine expressions")

    def isnull(self) -> Expr:
        return Call("isnull", (self,))

    def cast(self, target: str) -> Expr:
        return cast(self, target)


@dataclass(frozen=True, eq=False)
class Field(Expr):
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: Any

    def __str__(self):
        v = self.value
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(v)


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True, eq=False)
class Not(Expr):
    of: Expr

    def __str__(self):
        return f"(not {self.of})"


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


def wrap(v: Any) -> Expr:
    if isinstance(v, Expr):
        return v
    if v is not None and not isinstance(v, (bool, int, float, str)):
        raise TypeError(f"a literal must be null, bool, int, float or str; got {type(v).__name__}")
    return Literal(v)


def col(name: str) -> Expr:
    return Field(name)


def lit(v: Any) -> Expr:
    return wrap(v)


def isnull(e: Any) -> Expr:
    return Call("isnull", (wrap(e),))


def cast(e: Any, target: str) -> Expr:
    if target not in OF_CAST:
        raise ValueError(f"cast target must be one of {tuple(OF_CAST)}; got {target!r}")
    return Call("cast", (wrap(e), target))


def quadkey(lat: Any, lon: Any, zoom: Any) -> Expr:
    return Call("quadkey", (wrap(lat), wrap(lon), wrap(zoom)))


def null_test(e: Binary) -> Expr:
    """`x == null` and `x != null` ask whether x is null, whichever side the null is on."""
    for one, other in ((e.left, e.right), (e.right, e.left)):
        if isinstance(other, Literal) and other.value is None:
            return Call("isnull", (one,)) if e.op == "==" else Not(Call("isnull", (one,)))
    return e


# text ---------------------------------------------------------------------------------------------

_TOKENS = re.compile(r"\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<op>>=|<=|==|!=|[-+*/<>(),]))", re.ASCII)
_LEVELS = (("or",), ("and",), COMPARISONS, ("+", "-"), ("*", "/"))


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        end = len(text.rstrip())
        while at < end:
            m = _TOKENS.match(text, at)
            if not m:
                raise ExprError(f"unexpected character at {at + 1}: {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.depth = 0, 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None):
        token = self.peek()
        if text is not None and token[1] != text:
            raise ExprError(f"expected {text!r}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def level(self, k: int) -> Expr:
        self.depth += 1
        if self.depth > MAX_DEPTH * len(_LEVELS):
            raise ExprError(f"nested deeper than {MAX_DEPTH}")
        try:
            if k == len(_LEVELS):
                return self.atom()
            if k == 2 and self.peek() == ("name", "not"):
                self.take()
                return Not(self.level(2))
            left = self.level(k + 1)
            while self.peek()[0] in ("op", "name") and self.peek()[1] in _LEVELS[k]:
                left = Binary(self.take()[1], left, self.level(k + 1))
                if k == 2:
                    return null_test(left) if left.op in ("==", "!=") else left
            return left
        finally:
            self.depth -= 1

    def atom(self) -> Expr:
        kind, text = self.take()
        if text == "(":
            e = self.level(0)
            self.take(")")
            return e
        if kind == "op" and text == "-" and self.peek()[0] == "num":
            return Literal(-_number(self.take()[1]))
        if kind == "num":
            return Literal(_number(text))
        if kind == "str":
            return Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            if text in ("true", "false", "null"):
                return Literal({"true": True, "false": False, "null": None}[text])
            if text in ("and", "or", "not"):
                raise ExprError(f"{text!r} out of place")
            if self.peek()[1] == "(":
                return self.call(text)
            return Field(text)
        raise ExprError(f"unexpected {text or 'end'!r}")

    def call(self, name: str) -> Expr:
        self.take("(")
        args: list[Expr] = []
        while self.peek()[1] != ")":
            args.append(self.level(0))
            if self.peek()[1] != ",":
                break
            self.take(",")
        self.take(")")
        arity = {"isnull": 1, "cast": 2, "quadkey": 3}.get(name)
        if arity is None:
            raise ExprError(f"unknown function {name!r}")
        if len(args) != arity:
            raise ExprError(f"{name} takes {arity} arguments")
        if name == "cast":
            if not isinstance(args[1], Field) or args[1].name not in OF_CAST:
                raise ExprError(f"cast to one of {tuple(OF_CAST)}")
            return Call("cast", (args[0], args[1].name))
        return Call(name, tuple(args))


def _number(text: str) -> int | float:
    if re.fullmatch(r"\d+", text):
        n = int(text)
        if n > I64_MAX:
            raise ExprError(f"{text} does not fit 64 bits")
        return n
    return float(text)


def parse(text: str) -> Expr:
    p = _Parser(text)
    e = p.level(0)
    if p.peek()[0] != "end":
        raise ExprError(f"unexpected {p.peek()[1]!r}")
    return e


def as_expr(e: Any) -> Expr:
    """Expressions as they are, text parsed, other values as literals."""
    return parse(e) if isinstance(e, str) else wrap(e)


def fields_of(e: Any) -> set[str]:
    if isinstance(e, Field):
        return {e.name}
    if isinstance(e, Binary):
        return fields_of(e.left) | fields_of(e.right)
    if isinstance(e, Not):
        return fields_of(e.of)
    if isinstance(e, Call):
        return set().union(*(fields_of(a) for a in e.args))
    return set()


# compilation --------------------------------------------------------------------------------------


def compile_expr(e: Expr, schema: dict[str, str]) -> tuple[Column, str]:
    """The column of an expression and its field type. A lone null is a str."""
    c, kind = _compile(e, schema)
    return (c.cast("string"), "str") if kind == "null" else (c, kind)


def condition(e: Expr | None, schema: dict[str, str]) -> Column:
    """True where the expression is true; false and null are false."""
    if e is None:
        return F.lit(True)
    c, kind = compile_expr(e, schema)
    return F.coalesce(c, F.lit(False)) if kind == "bool" else F.lit(False)


def _compile(e: Expr, schema: dict[str, str]) -> tuple[Column, str]:
    if isinstance(e, Field):
        if e.name not in schema:
            raise ExprError(f"unknown field {e.name!r}")
        kind = schema[e.name]
        c = F.col(f"`{e.name}`")
        return (c.cast("double") if kind == "f64" else c.cast("long") if kind == "i64" else c), kind
    if isinstance(e, Literal):
        v = e.value
        if v is None:
            return F.lit(None), "null"
        kind = "bool" if isinstance(v, bool) else "i64" if isinstance(v, int) else "f64" if isinstance(v, float) else "str"
        return (F.lit(v).cast("long") if kind == "i64" else F.lit(v)), kind
    if isinstance(e, Not):
        c, kind = _compile(e.of, schema)
        if kind not in ("bool", "null"):
            raise ExprError(f"not takes bool, got {kind}")
        return ~c.cast("boolean"), "bool"
    if isinstance(e, Call):
        return _call(e, schema)
    (a, ka), (b, kb) = _compile(e.left, schema), _compile(e.right, schema)
    if ka == "null":
        a, ka = (a.cast({"i64": "long", "f64": "double", "bool": "boolean"}.get(kb, "string")), kb) if kb != "datetime" else (a.cast("timestamp"), kb)
    if kb == "null":
        b, kb = (b.cast({"i64": "long", "f64": "double", "bool": "boolean"}.get(ka, "string")), ka) if ka != "datetime" else (b.cast("timestamp"), ka)
    if e.op in ("and", "or"):
        if {ka, kb} - {"bool", "null"}:
            raise ExprError(f"{e.op} takes bool, got {ka} and {kb}")
        a, b = a.cast("boolean"), b.cast("boolean")
        return (a & b if e.op == "and" else a | b), "bool"
    numeric = {ka, kb} <= {"i64", "f64"}
    if e.op in COMPARISONS:
        if not numeric and ka != kb:
            raise ExprError(f"{e.op} cannot compare {ka} with {kb}")
        return _compare(e.op, a, ka, b, kb), "bool"
    if not numeric:
        if ka == kb == "null":
            return F.lit(None), "null"
        raise ExprError(f"{e.op} takes numbers, got {ka} and {kb}")
    if ka == kb == "i64":
        return _integer(e.op, a, b), "i64"
    return _float(e.op, a.cast("double"), b.cast("double")), "f64"


def _compare(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    plain = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[op]
    if "f64" not in (ka, kb):
        return plain
    return plain & ~(is_nan(a, ka) | is_nan(b, kb))


def _integer(op: str, a: Column, b: Column) -> Column:
    low, high = F.lit(I64_MIN).cast("long"), F.lit(I64_MAX).cast("long")
    if op == "/":
        by = F.when(b != 0, b)
        return F.when(b == -1, F.when(a == low, high).otherwise(-F.when(a != low, a))).otherwise(F.call_function("div", F.when(b != -1, a), by))
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    up = (a > 0) == (b > 0) if op == "*" else a >= 0
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(tried, F.when(up, high).otherwise(low)))


def _float(op: str, a: Column, b: Column) -> Column:
    if op != "/":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).when(a.isNotNull(), F.lit(math.nan))
    by_zero = F.when(F.isnan(a), F.lit(math.nan)).otherwise(by_zero)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def _call(e: Call, schema: dict[str, str]) -> tuple[Column, str]:
    if e.name == "isnull":
        return _compile(e.args[0], schema)[0].isNull(), "bool"
    if e.name == "cast":
        c, kind = _compile(e.args[0], schema)
        return cast_column(c, kind, e.args[1]), OF_CAST[e.args[1]]
    (lat, klat), (lon, klon), (zoom, kzoom) = (_compile(a, schema) for a in e.args)
    if {klat, klon} - {"i64", "f64", "null"} or kzoom not in ("i64", "null"):
        raise ExprError("quadkey takes two numbers and an int")
    return quadkey_column(lat.cast("double"), lon.cast("double"), zoom.cast("long")), "i64"


def cast_column(c: Column, kind: str, target: str) -> Column:
    """The cast matrix; what does not convert is null."""
    if kind == "datetime":
        c, kind = millis(c), "i64"
    if kind in ("bytes", "json", "null"):
        return F.lit(None).cast({"str": "string", "int": "long", "float": "double", "bool": "boolean"}[target])
    if target == "str":
        return float_text(c) if kind == "f64" else c.cast("string")
    if target == "int":
        if kind == "f64":
            whole = F.when(c >= 2.0**63, F.lit(I64_MAX).cast("long")).when(c <= -(2.0**63), F.lit(I64_MIN).cast("long"))
            inside = (c < 2.0**63) & (c > -(2.0**63))
            return F.when(F.isnan(c), F.lit(0).cast("long")).when(inside, F.when(inside, c).cast("long")).otherwise(whole)
        return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long")) if kind == "str" else c.cast("long")
    if target == "float":
        if kind != "str":
            return c.cast("int").cast("double") if kind == "bool" else c.cast("double")
        number = F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
        word = F.lower(F.regexp_replace(c, r"^[+]", ""))
        return F.coalesce(number, F.when(word.isin("inf", "infinity"), F.lit(math.inf)).when(word.isin("-inf", "-infinity"), F.lit(-math.inf)).when(word.isin("nan", "-nan"), F.lit(math.nan)))
    if kind == "str":
        return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))
    if kind == "f64":
        return F.when(c.isNotNull(), (c != 0) & ~F.isnan(c))
    return c if kind == "bool" else c != 0


def float_text(c: Column) -> Column:
    """A double without exponent and without a fraction of .0: 1 for 1.0, 0.00001 for 1e-5."""
    short = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(short, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(short, r"E(-?[0-9]+)$", 1).try_cast("int")
    bare = F.regexp_replace(digits, r"\.", "")
    point = F.length(F.substring_index(digits, ".", 1)) + power
    wide = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), bare))
        .when(point >= F.length(bare), F.concat(bare, F.repeat(F.lit("0"), point - F.length(bare))))
        .otherwise(F.concat(F.substring(bare, F.lit(1), point), F.lit("."), F.substring(bare, point + 1, F.length(bare))))
    )
    signed = F.concat(F.when(short.startswith("-"), F.lit("-")).otherwise(F.lit("")), wide)
    plain = F.regexp_replace(short, r"\.0$", "")
    named = F.when(F.isnan(c), F.lit("NaN")).when(short == "Infinity", F.lit("inf")).when(short == "-Infinity", F.lit("-inf"))
    return F.coalesce(named, F.when(short.contains("E"), signed).otherwise(plain))


def quadkey_column(lat: Column, lon: Column, zoom: Column) -> Column:
    """Tile number column * 2^zoom + row on a grid of equal sine and longitude steps; null unless zoom is 1 to 24."""
    n = F.pow(F.lit(2.0), zoom).cast("long")
    edge = 85.05112878  # fixed value: the latitude at which the square world map ends
    row = F.floor((F.sin(F.radians(F.greatest(F.lit(-edge), F.least(F.lit(edge), lat)))) + 1) / 2 * n)
    column = F.floor((lon + 180.0) / 360.0 * n)
    ok = zoom.between(1, 24) & lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(ok, column * n + F.greatest(F.lit(0).cast("long"), F.least(n - 1, row))).cast("long")
