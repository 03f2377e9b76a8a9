"""The consistency rule's expression language as Catalyst columns.

Columns stand in back-ticks; `&`, `|` bind like `and`, `or`; comparisons and
predicates are two-valued (a null compares false, and `!=` true).  Statistics
of whole columns are computed beforehand over all rows and stand as literals.
Whatever depends on the order of rows is refused.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passrate.errors import DQFunctionError
from passrate.functions import nulls
from passrate.functions.dates import to_utc_datetime
from passrate.functions.patterns import matches, quoted, replacement, translate

_TICKED = re.compile(r"`([^`]+)`")
_STATISTICS = {"mean", "std", "var", "median", "quantile", "mode", "min", "max", "sum", "prod", "count", "nunique", "sem", "skew", "kurt"}
_MATH = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "expm1": F.expm1, "log1p": F.log1p, "sqrt": F.sqrt,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh,
    "arccosh": F.acosh, "arctanh": F.atanh, "log10": F.log10, "floor": F.floor, "ceil": F.ceil, "abs": F.abs,
}


def ticked_fields(expression: str) -> list[str]:
    return list(dict.fromkeys(_TICKED.findall(expression)))


def columns_in(expression: str | dict[str, str]) -> list[str]:
    """The back-ticked columns of an expression, or of both parts of an if/then."""
    parts = expression.values() if isinstance(expression, dict) else [expression]
    found = list(dict.fromkeys(f for part in parts for f in ticked_fields(part)))
    if not found:
        raise ValueError(f"no back-ticked column in {expression!r}")
    return found


def with_safe_names(expression: str | dict[str, str], rename: Callable[[str], str]) -> str | dict[str, str]:
    if isinstance(expression, dict):
        return {k: with_safe_names(v, rename) for k, v in expression.items()}
    return _TICKED.sub(lambda m: f"`{rename(m[1])}`", expression)


@dataclass
class Value:
    """A typed operand: a column, or a Python constant not yet turned into one."""

    kind: str  # bool, num, int, str, ts, td (seconds), list, const-null
    column: Column | None = None
    constant: Any = None
    is_constant: bool = False
    scalar: bool = False  # the same in every row
    name: str | None = None

    def get(self) -> Column:
        if self.column is None:
            if self.kind == "ts":
                return F.lit(self.constant.isoformat()).cast("timestamp")
            return F.lit(self.constant)
        return self.column


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "num"
    if isinstance(data_type, T.StringType):
        return "str"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "ts"
    raise DQFunctionError(f"a {data_type.simpleString()} column cannot stand in an expression")


def parse(expression: str) -> tuple[ast.expr, dict[str, str]]:
    """The syntax tree, and the column for each placeholder."""
    names: dict[str, str] = {}

    def place(m: re.Match) -> str:
        key = next((k for k, v in names.items() if v == m[1]), f"__column_{len(names)}__")
        names[key] = m[1]
        return key

    text = _TICKED.sub(place, " ".join(expression.split("\n")).strip())
    try:
        tokens = [{"&": "and", "|": "or"}.get(t.string, t.string) if t.type == tokenize.OP else t.string for t in tokenize.generate_tokens(io.StringIO(text).readline)]
        tree = ast.parse(" ".join(tokens).strip(), mode="eval").body
    except (SyntaxError, tokenize.TokenError, IndentationError) as error:
        raise DQFunctionError(f"cannot read the expression {expression!r}: {error}") from error
    return tree, names


@dataclass(frozen=True)
class Statistic:
    name: str
    column: str
    argument: float | None = None


def statistics_in(expression: str) -> list[Statistic]:
    """The whole-column statistics that an expression uses."""
    tree, names = parse(expression)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in _STATISTICS:
            owner = node.func.value
            if isinstance(owner, ast.Attribute) and owner.attr == "str":
                continue  # .str.count() is of each row's text
            if not isinstance(owner, ast.Name) or owner.id not in names:
                raise DQFunctionError(f"{node.func.attr}() is for columns only, in {expression!r}")
            out.append(_statistic(node, names[owner.id]))
    return out


def _statistic(node: ast.Call, column: str) -> Statistic:
    given = arguments_of(node, ("q",) if node.func.attr == "quantile" else ())
    if node.func.attr == "quantile":
        q = float(given.get("q", 0.5))
        if not 0 <= q <= 1:
            raise DQFunctionError(f"a quantile is from 0 to 1, in {ast.unparse(node)}")
        return Statistic("quantile", column, q)
    return Statistic(node.func.attr, column)


def arguments_of(node: ast.Call, names: tuple[str, ...], keywords: tuple[str, ...] = ()) -> dict[str, Any]:
    """A call's constant arguments by name; `keywords` go by name only, and any other one is refused."""
    if len(node.args) > len(names):
        raise DQFunctionError(f"too many arguments in {ast.unparse(node)}")
    out = {n: ast.literal_eval(a) for n, a in zip(names, node.args, strict=False)}
    for k in node.keywords:
        if k.arg not in names + keywords or k.arg in out:
            raise DQFunctionError(f"{k.arg}= is no argument here, in {ast.unparse(node)}")
        out[k.arg] = ast.literal_eval(k.value)
    return out


def statistic_column(statistic: Statistic, column: Column) -> Column:
    """The aggregate that computes it; nulls are left out."""
    number = column.cast("double") if statistic.name in ("mean", "std", "var", "sem", "skew", "kurt", "prod") else column
    simple = {
        "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
        "nunique": F.count_distinct, "prod": F.product,
    }
    n = F.count(number).cast("double")
    if statistic.name == "sem":
        return F.stddev_samp(number) / F.sqrt(n)
    if statistic.name == "skew":  # corrected for bias; of equal values 0
        return F.when(n >= 3, F.when(F.var_pop(number) == 0, F.lit(0.0)).otherwise(F.skewness(number) * F.sqrt(n * (n - 1)) / (n - 2)))
    if statistic.name == "kurt":
        return F.when(n >= 4, F.when(F.var_pop(number) == 0, F.lit(0.0)).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(number) + 6)))
    return simple[statistic.name](number)


class Compiler:
    """Compiles one expression against bound columns: name -> (column, kind)."""

    def __init__(self, bound: dict[str, tuple[Column, str]], statistics: dict[Statistic, Any]):
        self.bound, self.statistics = bound, statistics

    def condition(self, expression: str) -> Column:
        """A two-valued condition; anything that is not one raises."""
        tree, self.names = parse(expression)
        try:
            value = self.visit(tree)
        except DQFunctionError:
            raise
        except Exception as error:
            raise DQFunctionError(f"cannot evaluate {expression!r}: {error}") from error
        if value.kind != "bool" or value.scalar or value.is_constant:
            raise DQFunctionError(f"{expression!r} does not give a true or false value for each row; compare it, as with == True")
        return nulls.surely(value.get())

    # -- nodes

    def visit(self, node: ast.AST) -> Value:
        method = getattr(self, f"visit_{type(node).__name__}", None)
        if method is None:
            raise DQFunctionError(f"{type(node).__name__} is no part of the expression language")
        return method(node)

    def visit_Constant(self, node: ast.Constant) -> Value:
        v = node.value
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "num" if isinstance(v, float) else "str" if isinstance(v, str) else None
        if kind is None:
            raise DQFunctionError(f"{v!r} is no constant of the expression language")
        return Value(kind, constant=v, is_constant=True, scalar=True)

    def visit_Name(self, node: ast.Name) -> Value:
        if node.id not in self.names:
            raise DQFunctionError(f"'{node.id}' is unknown; columns stand in back-ticks")
        name = self.names[node.id]
        column, kind = self.bound[name]
        return Value(kind, column, name=name)

    def visit_List(self, node: ast.List | ast.Tuple) -> Value:
        return Value("list", constant=[ast.literal_eval(e) for e in node.elts], is_constant=True, scalar=True)

    visit_Tuple = visit_Set = visit_List

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:
        parts = [self.visit(v) for v in node.values]
        for p in parts:
            if p.kind != "bool":
                raise DQFunctionError("and, or join conditions")
        join = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
        return Value("bool", reduce(join, [nulls.surely(p.get()) for p in parts]), scalar=all(p.scalar for p in parts))

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:
        value = self.visit(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            if value.kind != "bool":
                raise DQFunctionError("not and ~ are for conditions")
            return Value("bool", ~nulls.surely(value.get()), scalar=value.scalar)
        if value.kind not in ("int", "num"):
            raise DQFunctionError("a sign is for numbers")
        if value.is_constant:
            return Value(value.kind, constant=-value.constant if isinstance(node.op, ast.USub) else value.constant, is_constant=True, scalar=True)
        return Value(value.kind, -value.get() if isinstance(node.op, ast.USub) else value.get(), scalar=value.scalar)

    def visit_Compare(self, node: ast.Compare) -> Value:
        operands = [self.visit(n) for n in (node.left, *node.comparators)]
        parts = [self._compare(a, op, b) for a, op, b in zip(operands[:-1], node.ops, operands[1:], strict=True)]
        return Value("bool", reduce(lambda a, b: a & b, parts), scalar=all(o.scalar for o in operands))

    def _compare(self, a: Value, op: ast.cmpop, b: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            found = self._is_in(a, b.constant if b.kind == "list" else [b.constant])
            return ~found if isinstance(op, ast.NotIn) else found
        if b.kind == "list" or a.kind == "list":
            value, items = (a, b) if b.kind == "list" else (b, a)
            if isinstance(op, (ast.Eq, ast.NotEq)):
                found = self._is_in(value, items.constant)
                return ~found if isinstance(op, ast.NotEq) else found
            raise DQFunctionError("lists are compared by in, not in, == and != only")
        a, b = self._together(a, b)
        if a is None:
            if isinstance(op, (ast.Eq, ast.NotEq)):
                return F.lit(isinstance(op, ast.NotEq))
            raise DQFunctionError("these types have no order between them")
        x, y = a.get(), b.get()
        if isinstance(op, ast.Eq):
            return nulls.surely(x == y)
        if isinstance(op, ast.NotEq):
            return F.coalesce(x != y, F.lit(True))
        ordered = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}.get(type(op))
        if ordered is None:
            raise DQFunctionError("is and is not are no part of the expression language")
        return nulls.surely(ordered)

    def _together(self, a: Value, b: Value) -> tuple[Value | None, Value | None]:
        """Both as one comparable kind, or (None, None)."""
        if a.kind == b.kind or {a.kind, b.kind} <= {"int", "num"}:
            return a, b
        if {a.kind, b.kind} <= {"int", "num", "bool"}:
            number = lambda v: v if v.kind != "bool" else Value("int", constant=int(v.constant), is_constant=True, scalar=True) if v.is_constant else Value("int", v.get().cast("int"), scalar=v.scalar)
            return number(a), number(b)
        for one, other, swap in ((a, b, False), (b, a, True)):
            if one.kind in ("ts", "td") and other.kind == "str" and other.is_constant:
                if one.kind == "ts":
                    stamp = to_utc_datetime(other.constant)
                    if pd.isna(stamp):
                        raise DQFunctionError(f"{other.constant!r} is no date")
                    other = Value("ts", constant=stamp, is_constant=True, scalar=True)
                else:
                    other = Value("num", constant=pd.Timedelta(other.constant).total_seconds(), is_constant=True, scalar=True)
                return (other, one) if swap else (one, other)
        return None, None

    def _is_in(self, value: Value, items: list) -> Column:
        kind = {"bool": T.BooleanType(), "int": T.LongType(), "num": T.DoubleType(), "str": T.StringType(), "ts": T.TimestampType()}[value.kind]
        found = nulls.is_in(value.get(), items, kind, parse_dates=True)
        return found | value.get().isNull() if any(nulls.is_null_literal(i) for i in items) else found

    def visit_BinOp(self, node: ast.BinOp) -> Value:
        a, b = self.visit(node.left), self.visit(node.right)
        scalar = a.scalar and b.scalar
        if a.kind == "bool" and b.kind == "bool" and isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            x, y = nulls.surely(a.get()), nulls.surely(b.get())
            return Value("bool", {ast.BitAnd: x & y, ast.BitOr: x | y, ast.BitXor: x != y}[type(node.op)], scalar=scalar)
        if a.kind == "str" and b.kind == "str" and isinstance(node.op, ast.Add):
            return Value("str", F.concat(a.get(), b.get()), scalar=scalar)
        if isinstance(node.op, ast.Sub) and "ts" in (a.kind, b.kind):
            x, y = self._together(a, b)
            if x is not None and x.kind == y.kind == "ts":
                return Value("td", (F.unix_micros(x.get()) - F.unix_micros(y.get())) / F.lit(1e6), scalar=scalar)
        if a.kind == "ts" and b.kind == "td" and isinstance(node.op, (ast.Add, ast.Sub)):
            sign = 1 if isinstance(node.op, ast.Add) else -1
            return Value("ts", F.timestamp_micros((F.unix_micros(a.get()) + sign * b.get() * 1e6).cast("long")), scalar=scalar)
        numeric = {"int", "num", "bool"}
        if a.kind not in numeric or b.kind not in numeric:
            raise DQFunctionError(f"no arithmetic between {a.kind} and {b.kind}")
        exact = a.kind == b.kind == "int" and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult))
        x, y = (v.get().cast("long" if exact else "double") for v in (a, b))
        if exact:
            return Value("int", {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[type(node.op)](x, y), scalar=scalar)
        quotient = F.when(y != 0, x / y).when(x != 0, F.signum(x) * F.lit(float("inf")))
        out = {
            ast.Add: lambda: x + y,
            ast.Sub: lambda: x - y,
            ast.Mult: lambda: x * y,
            ast.Div: lambda: quotient,
            ast.FloorDiv: lambda: F.when(y != 0, self._floor(x / y)).otherwise(quotient),
            ast.Mod: lambda: F.when(y != 0, x - y * self._floor(x / y)),
            ast.Pow: lambda: F.pow(x, y),
        }.get(type(node.op))
        if out is None:
            raise DQFunctionError(f"{type(node.op).__name__} is no part of the expression language")
        return Value("num", _no_nan(out()), scalar=scalar)

    @staticmethod
    def _floor(x: Column) -> Column:
        return F.when(F.abs(x) < 9e18, F.floor(x).cast("double")).otherwise(x)

    def visit_Subscript(self, node: ast.Subscript) -> Value:
        owner = node.value.value if isinstance(node.value, ast.Attribute) and node.value.attr == "iloc" else node.value
        if isinstance(owner, ast.Call) and self._method(owner) == ("", "mode"):
            if ast.literal_eval(node.slice) != 0:
                raise DQFunctionError("of the modes only the first is known, as .mode()[0]")
            return self._whole(owner, "mode")
        if not (isinstance(node.value, ast.Attribute) and node.value.attr == "str"):
            raise DQFunctionError("subscripts are for .str only")
        if isinstance(node.value.value, ast.Call) and self._method(node.value.value) == ("str", "split"):
            if isinstance(node.slice, ast.Slice):
                raise DQFunctionError("the parts of .str.split() have no slices here")
            return self._part(node.value.value, ast.literal_eval(node.slice))
        text = self._text(node.value.value)
        if isinstance(node.slice, ast.Slice):
            bound = lambda n: None if n is None else ast.literal_eval(n)
            return Value("str", _slice(text, bound(node.slice.lower), bound(node.slice.upper)))
        at = ast.literal_eval(node.slice)
        return self._character(text, at)

    def _part(self, split: ast.Call, at: int) -> Value:
        return Value("str", F.try_element_at(self._split(split), F.lit(at + 1 if at >= 0 else at)))

    @staticmethod
    def _character(text: Column, at: int) -> Value:
        one = _slice(text, at, at + 1 if at != -1 else None)
        return Value("str", F.when(F.length(one) > 0, one))

    # -- calls and attributes

    @staticmethod
    def _method(node: ast.Call) -> tuple[str, str]:
        f = node.func
        if isinstance(f, ast.Attribute):
            return (f.value.attr if isinstance(f.value, ast.Attribute) and f.value.attr in ("str", "dt") else "", f.attr)
        return "", ""

    def _text(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Call) and self._method(node) == ("str", "split"):
            raise DQFunctionError("the parts of .str.split() are for .str[i], .str.get(), .str.len() and .str.join()")
        value = self.visit(node)
        if value.kind != "str":
            raise DQFunctionError(".str is for text")
        return value.get()

    def _split(self, node: ast.Call) -> Column:
        text = self._text(node.func.value.value)
        a = self._arguments(node, ("pat",), ("n", "expand", "regex"))
        if a.get("expand"):
            raise DQFunctionError("expand=True gives a table")
        pat, limit = a.get("pat"), a["n"] + 1 if a.get("n", -1) > 0 else -1
        if pat is None:
            text = F.regexp_replace(text, r"^(?U)\s+" if limit > 0 else r"(?U)^\s+|\s+\z", "")
            return F.when(text == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(text, r"(?U)\s+", limit), lambda x: F.length(x) > 0))
        as_regex = len(pat) > 1 if a.get("regex") is None else a["regex"]
        return F.split(text, "(?dU)" + translate(pat) if as_regex else quoted(pat), limit)

    _arguments = staticmethod(arguments_of)

    def visit_Attribute(self, node: ast.Attribute) -> Value:
        if isinstance(node.value, ast.Attribute) and node.value.attr == "dt":
            owner = self.visit(node.value.value)
            if owner.kind == "td":
                seconds = owner.get()
                parts = {"days": F.floor(seconds / 86400), "seconds": F.floor(seconds) % 86400}
                if node.attr in parts:
                    return Value("int", parts[node.attr].cast("long"))
            elif owner.kind == "ts":
                c = owner.get()
                parts = {
                    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
                    "dayofweek": F.weekday, "weekday": F.weekday, "day_of_week": F.weekday, "dayofyear": F.dayofyear, "day_of_year": F.dayofyear,
                }
                if node.attr in parts:
                    return Value("int", parts[node.attr](c))
                flags = {
                    "is_month_start": F.dayofmonth(c) == 1, "is_month_end": F.to_date(c) == F.last_day(c), "is_year_start": F.dayofyear(c) == 1,
                    "is_year_end": (F.month(c) == 12) & (F.dayofmonth(c) == 31), "is_leap_year": F.dayofmonth(F.last_day(F.make_date(F.year(c), F.lit(2), F.lit(1)))) == 29,
                }
                if node.attr in flags:
                    return Value("bool", nulls.surely(flags[node.attr]))
                if node.attr == "date":
                    return Value("ts", F.date_trunc("day", c))
            raise DQFunctionError(f".dt.{node.attr} is unknown here")
        raise DQFunctionError(f".{node.attr} is no part of the expression language")

    def visit_Call(self, node: ast.Call) -> Value:
        if isinstance(node.func, ast.Name):
            return self._function(node)
        space, name = self._method(node)
        if space == "str":
            return self._string(node, name)
        if space == "dt":
            owner = self.visit(node.func.value.value)
            if owner.kind == "td" and name == "total_seconds":
                return Value("num", owner.get())
            if owner.kind == "ts" and name in ("normalize", "date"):
                return Value("ts", F.date_trunc("day", owner.get()))
            if owner.kind == "ts" and name in ("day_name", "month_name"):
                return Value("str", F.date_format(owner.get(), "EEEE" if name == "day_name" else "MMMM"))
            raise DQFunctionError(f".dt.{name}() is unknown here")
        if name == "mode":
            raise DQFunctionError("a column can have several modes; the first is .mode()[0]")
        if name in _STATISTICS and isinstance(node.func.value, ast.Name):
            return self._whole(node, name)
        return self._series(node, name)

    def _whole(self, node: ast.Call, name: str) -> Value:
        """A statistic, as the constant it was found to be."""
        found = self.statistics.get(_statistic(node, self.names.get(node.func.value.id, "")))
        kind = self.bound[self.names[node.func.value.id]][1]
        if found is None:
            return Value("num", F.lit(None).cast("double"), scalar=True)
        if kind == "ts" and name in ("min", "max", "mode"):
            return Value("ts", constant=to_utc_datetime(found), is_constant=True, scalar=True)
        return Value("bool" if isinstance(found, bool) else "str" if isinstance(found, str) else "num" if isinstance(found, float) else "int", constant=found, is_constant=True, scalar=True)

    def _function(self, node: ast.Call) -> Value:
        name = node.func.id
        values = [self.visit(a) for a in node.args]
        if any(v.kind not in ("int", "num", "bool") for v in values):
            raise DQFunctionError(f"{name}() is for numbers")
        if name == "abs" and len(values) == 1:
            return Value(values[0].kind, F.abs(values[0].get()), scalar=values[0].scalar)
        columns = [v.get().cast("double") for v in values]
        if name == "arctan2" and len(columns) == 2:
            return Value("num", F.atan2(*columns), scalar=all(v.scalar for v in values))
        if name not in _MATH or len(columns) != 1:
            raise DQFunctionError(f"{name}() is no function of the expression language")
        return Value("num", _no_nan(_MATH[name](columns[0]).cast("double")), scalar=values[0].scalar)

    def _series(self, node: ast.Call, name: str) -> Value:
        value = self.visit(node.func.value)
        c = value.get()
        if name in ("isnull", "isna"):
            return Value("bool", c.isNull())
        if name in ("notnull", "notna"):
            return Value("bool", c.isNotNull())
        if name == "isin":
            return Value("bool", self._is_in(value, list(self._arguments(node, ("values",))["values"])))
        if name == "between":
            given = dict(zip(("left", "right", "inclusive"), node.args, strict=False)) | {k.arg: k.value for k in node.keywords}
            if set(given) - {"left", "right", "inclusive"} or len(node.args) > 3:
                raise DQFunctionError(f"between() takes left, right and inclusive, not as in {ast.unparse(node)}")
            low, high = self.visit(given["left"]), self.visit(given["right"])
            inclusive = ast.literal_eval(given["inclusive"]) if "inclusive" in given else "both"
            ops = (ast.GtE() if inclusive in ("both", "left") else ast.Gt(), ast.LtE() if inclusive in ("both", "right") else ast.Lt())
            return Value("bool", self._compare(value, ops[0], low) & self._compare(value, ops[1], high))
        if name in ("gt", "ge", "lt", "le", "eq", "ne", "fillna", "astype", "add", "sub", "mul", "div", "truediv", "floordiv", "mod", "pow") and (node.keywords or len(node.args) != 1):
            raise DQFunctionError(f".{name}() takes one argument here, not as in {ast.unparse(node)}")
        if name in ("isnull", "isna", "notnull", "notna", "abs"):
            self._arguments(node, ())
        if name in ("gt", "ge", "lt", "le", "eq", "ne"):
            op = {"gt": ast.Gt, "ge": ast.GtE, "lt": ast.Lt, "le": ast.LtE, "eq": ast.Eq, "ne": ast.NotEq}[name]()
            return Value("bool", self._compare(value, op, self.visit(node.args[0])))
        if name == "fillna":
            other = self.visit(node.args[0])
            a, b = self._together(value, other)
            if a is None:
                raise DQFunctionError("fillna() needs a value of the column's kind")
            return Value(a.kind if a.kind == b.kind else "num", F.coalesce(a.get(), b.get()))
        if name == "astype":
            return self._astype(value, node)
        if name == "abs":
            return Value(value.kind, F.abs(c), scalar=value.scalar)
        if name == "round":
            digits = self._arguments(node, ("decimals",)).get("decimals", 0)
            return Value(value.kind, c if value.kind == "int" and digits >= 0 else F.bround(c, digits), scalar=value.scalar)
        if name == "clip":
            arguments = self._arguments(node, ("lower", "upper"))
            out = c
            if arguments.get("lower") is not None:
                out = F.greatest(out, F.lit(arguments["lower"]))
            if arguments.get("upper") is not None:
                out = F.least(out, F.lit(arguments["upper"]))
            return Value("num", F.when(c.isNotNull(), out))
        if name in ("add", "sub", "mul", "div", "truediv", "floordiv", "mod", "pow"):
            op = {"add": ast.Add, "sub": ast.Sub, "mul": ast.Mult, "div": ast.Div, "truediv": ast.Div, "floordiv": ast.FloorDiv, "mod": ast.Mod, "pow": ast.Pow}[name]()
            return self.visit_BinOp(ast.BinOp(node.func.value, op, node.args[0]))
        if name in ("rank", "duplicated"):
            raise DQFunctionError(f".{name}() compares every row with all others; a uniqueness rule counts repeated values")
        if name in ("shift", "diff", "cumsum", "cumprod", "cummax", "cummin", "ffill", "bfill", "rolling", "expanding", "pct_change", "interpolate"):
            raise DQFunctionError(f".{name}() depends on the order of rows, which a distributed table has not")
        raise DQFunctionError(f".{name}() is no part of the expression language")

    def _astype(self, value: Value, node: ast.Call) -> Value:
        wanted = node.args[0].id if isinstance(node.args[0], ast.Name) else str(ast.literal_eval(node.args[0]))
        c = value.get()
        if wanted.startswith("str"):
            text = F.when(c, "True").when(~c, "False") if value.kind == "bool" else c.cast("string")
            return Value("str", text)
        if wanted.startswith("int"):
            return Value("int", c.try_cast("long"))
        if wanted.startswith("float"):
            return Value("num", _no_nan(c.try_cast("double")))
        if wanted.startswith("bool"):
            return Value("bool", nulls.surely(F.length(c) > 0 if value.kind == "str" else c if value.kind == "bool" else c != 0))
        raise DQFunctionError(f"astype({wanted!r}) is unknown here")

    def _string(self, node: ast.Call, name: str) -> Value:
        owner = node.func.value.value
        get = lambda *names: self._arguments(node, names)
        if isinstance(owner, ast.Call) and self._method(owner) == ("str", "split"):
            if name == "len":
                return Value("int", F.size(self._split(owner)))
            if name == "get":
                return self._part(owner, get("i")["i"])
            if name == "join":
                return Value("str", F.array_join(self._split(owner), get("sep")["sep"]))
        text = self._text(owner)
        if name == "get":
            return self._character(text, get("i")["i"])
        if name in ("startswith", "endswith"):
            a = get("pat", "na")
            wanted = a["pat"] if isinstance(a["pat"], tuple) else (a["pat"],)
            test = F.startswith if name == "startswith" else F.endswith
            return Value("bool", nulls.surely(reduce(lambda x, y: x | y, [test(text, F.lit(w)) for w in wanted])))
        if name in ("contains", "match", "fullmatch"):
            a = get("pat", "case", "flags", "na", "regex") if name == "contains" else get("pat", "case", "flags", "na")
            ignore = a.get("case") is False or _ignores_case(a)
            if a.get("regex") is False:
                found = F.contains(F.lower(text), F.lit(a["pat"].lower())) if ignore else F.contains(text, F.lit(a["pat"]))
            else:
                found = matches(text, a["pat"], {"contains": "search"}.get(name, name), ignore)
            return Value("bool", F.coalesce(found, F.lit(bool(a["na"]) if isinstance(a.get("na"), bool) else False)))
        if name == "len":
            return Value("int", F.length(text))
        if name == "count":
            a = get("pat", "flags")
            return Value("int", F.regexp_count(text, F.lit(("(?dUi)" if _ignores_case(a) else "(?dU)") + translate(a["pat"]))))
        if name == "find":
            return Value("int", F.instr(text, get("sub")["sub"]) - 1)
        if name == "repeat":
            return Value("str", F.repeat(text, get("repeats")["repeats"]))
        if name in ("removeprefix", "removesuffix"):
            cut = get("prefix" if name == "removeprefix" else "suffix").popitem()[1]
            shorter = F.length(text) - len(cut)
            return Value("str", F.when(F.startswith(text, F.lit(cut)), F.substring(text, F.lit(len(cut) + 1), shorter)).otherwise(text) if name == "removeprefix" else F.when(F.endswith(text, F.lit(cut)), F.substring(text, F.lit(1), shorter)).otherwise(text))
        if name in ("lower", "casefold"):
            return Value("str", F.lower(text))
        if name == "upper":
            return Value("str", F.upper(text))
        if name in ("title", "capitalize"):
            get()
            first_up = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
            whole = F.lower(text)
            runs = F.regexp_extract_all(whole, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
            return Value("str", F.array_join(F.transform(runs, first_up), "") if name == "title" else first_up(whole))
        if name in ("strip", "lstrip", "rstrip"):
            chars = get("to_strip").get("to_strip")
            members = r"\s" if chars is None else re.sub(r"([^A-Za-z0-9\s])", r"\\\1", chars)
            out = text
            if name != "rstrip":
                out = F.regexp_replace(out, rf"^(?U)[{members}]+", "")
            if name != "lstrip":
                out = F.regexp_replace(out, rf"(?U)[{members}]+\z", "")
            return Value("str", out)
        if name == "replace":
            a = get("pat", "repl", "n", "case", "flags", "regex")
            ignore, n = a.get("case") is False or _ignores_case(a), a.get("n", -1)
            if not (a.get("regex") or ignore or n >= 0):
                return Value("str", F.replace(text, F.lit(a["pat"]), F.lit(a["repl"])))
            pattern = ("(?dUi)" if ignore else "(?dU)") + (translate(a["pat"]) if a.get("regex") else quoted(a["pat"]))
            groups = bool(a.get("regex")) and "\\" in a["repl"]
            if n < 0:
                repl = replacement(a["repl"]) if a.get("regex") else a["repl"].replace("\\", r"\\").replace("$", r"\$")
                return Value("str", F.regexp_replace(text, pattern, repl))
            if groups:
                raise DQFunctionError("n= and group references exclude each other here")
            return Value("str", text if n == 0 else F.array_join(F.split(text, pattern, n + 1), a["repl"]))
        if name == "slice":
            a = get("start", "stop")
            return Value("str", _slice(text, a.get("start"), a.get("stop")))
        if name in ("zfill", "ljust", "rjust"):
            a = get("width", "fillchar")
            fill = "0" if name == "zfill" else a.get("fillchar", " ")
            padded = (F.rpad if name == "ljust" else F.lpad)(text, a["width"], fill)
            if name == "zfill":  # a sign stays in front
                signed = F.concat(F.substring(text, 1, 1), F.lpad(F.substring(text, 2, 1 << 30), max(0, a["width"] - 1), fill))
                padded = F.when(text.rlike(r"\A[+-]"), signed).otherwise(padded)
            return Value("str", F.when(F.length(text) >= a["width"], text).otherwise(padded))
        tests = {
            "isdecimal": r"\A\p{Nd}+\z", "isalpha": r"\A\p{L}+\z", "isspace": r"(?U)\A\s+\z",
            "isupper": r"\A(?=.*\p{Lu})[^\p{Ll}]*\z", "islower": r"\A(?=.*\p{Ll})[^\p{Lu}]*\z", "istitle": r"\A[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+|\z))+\z",
        }
        if name in ("isdigit", "isnumeric", "isalnum"):
            get()
            return Value("bool", nulls.surely(text.rlike(rf"\A[{_class_of(name)}]+\z")))
        if name in tests:
            get()
            return Value("bool", nulls.surely(text.rlike("(?s)" + tests[name])))
        raise DQFunctionError(f".str.{name}() is unknown here")


@lru_cache
def _class_of(test: str) -> str:
    """The ranges of characters for which Python's test holds, as a class of the JVM's patterns."""
    holds = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and getattr(chr(c), test)()]
    out, start = [], 0
    for i in range(1, len(holds) + 1):
        if i == len(holds) or holds[i] != holds[i - 1] + 1:
            out.append(rf"\x{{{holds[start]:x}}}-\x{{{holds[i - 1]:x}}}")
            start = i
    return "".join(out)


def _ignores_case(arguments: dict[str, Any]) -> bool:
    flags = arguments.get("flags", 0)
    if flags & ~re.IGNORECASE:
        raise DQFunctionError(f"of the flags only {int(re.IGNORECASE)}, for any case, is known; others stand in the pattern")
    return bool(flags)


def _no_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def _slice(text: Column, start: int | None, stop: int | None) -> Column:
    n = F.length(text)
    at = lambda k, default: default if k is None else F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))
    low, high = at(start, F.lit(0)), at(stop, n)
    return F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))
