"""Safe expressions: trees of plain data to Spark columns."""

from __future__ import annotations

import operator
from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compat


class ExpressionError(ValueError):
    """A tree isn't an expression."""


def _log(x: Column, *more: Column) -> Column:
    return F.ln(more[0]) / F.ln(x) if more else F.log10(x)




#: name: (least and most arguments, function)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs),
    "round": (1, 2, lambda x, *n: F.round(x, *n)),
    "coalesce": (2, 10, F.coalesce),
    "sqrt": (1, 1, F.sqrt),
    "log": (1, 2, _log),
    "lower": (1, 1, F.lower),
    "upper": (1, 1, F.upper),
    "trim": (1, 1, F.trim),
    "replace": (3, 3, F.replace),
    "concat": (2, 20, compat.concat),
    "length": (1, 1, lambda x: F.length(x).cast("bigint")),
}
#: functions with a plain text argument, by its position
FORMATTED = {
    "strftime": (1, lambda ts, fmt: compat.strftime(ts, fmt)),
    "date_trunc": (0, lambda unit, ts: compat.date_trunc(unit, ts)),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": operator.add,
    "-": operator.sub,
    "*": operator.mul,
    "/": compat.divide,
    "%": compat.modulo,
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "like": compat.like,
    "ilike": compat.ilike,
}


def compile_expr(tree: object, allowed: Collection[str] | None = None) -> Column:
    """The column that ``tree`` describes.

    Nodes are ``{"col": name}``, ``{"val": literal}`` and ``{"op": ...}``; see
    the README.  A non-empty ``allowed`` is the set of columns that may occur.
    """
    known = set(allowed or ()) or None

    def need(node: dict, *fields: str) -> list:
        missing = [f for f in fields if f not in node]
        if missing:
            raise ExpressionError(f"{node.get('op')}: missing {', '.join(missing)}")
        return [node[f] for f in fields]

    def listed(node: object) -> list | None:
        value = node.get("val") if isinstance(node, dict) else node
        return list(value) if isinstance(value, (list, tuple)) else None

    def call(name: str, args: list) -> Column:
        if name in FORMATTED:
            if len(args) != 2:
                raise ExpressionError(f"{name} takes 2 arguments")
            at, fn = FORMATTED[name]
            text = args[at].get("val") if isinstance(args[at], dict) else args[at]
            if not isinstance(text, str):
                raise ExpressionError(f"{name}: argument {at + 1} must be a literal text")
            values = [text if i == at else build(a) for i, a in enumerate(args)]
            return fn(*values)
        least, most, fn = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments")
        if name == "round" and len(args) == 2:
            digits = args[1].get("val") if isinstance(args[1], dict) else args[1]
            if not isinstance(digits, int):
                raise ExpressionError("round: digits must be a literal integer")
            return fn(build(args[0]), digits)
        return fn(*[build(a) for a in args])

    def build(node: object) -> Column:
        if not isinstance(node, dict):
            raise ExpressionError(f"not an expression: {node!r}")
        if "col" in node:
            name = node["col"]
            if not isinstance(name, str) or not name or '"' in name:
                raise ExpressionError(f"not a column name: {name!r}")
            if known is not None and name not in known:
                raise ExpressionError(f"unknown column: {name}")
            return compat.col(name)
        if "val" in node:
            if isinstance(node["val"], (list, tuple)):
                raise ExpressionError("a list stands only to the right of in")
            return F.lit(node["val"])
        if "op" not in node:
            raise ExpressionError("an expression has col, val or op")
        op = str(node["op"]).lower()
        if op in ("and", "or"):
            args = need(node, "args")[0]
            if len(args) < 2:
                raise ExpressionError(f"{op} takes 2 arguments or more")
            return reduce(operator.and_ if op == "and" else operator.or_, [build(a) for a in args])
        if op == "not" or (op == "-" and "arg" in node and "left" not in node):
            arg = build(need(node, "arg")[0])
            return ~arg if op == "not" else -arg
        if op == "between":
            value, low, high = (build(x) for x in need(node, "value", "low", "high"))
            return (value >= low) & (value <= high) if node.get("inclusive", True) else (value > low) & (value < high)
        if op == "in":
            left, right = need(node, "left", "right")
            values = listed(right)
            if values is None:
                raise ExpressionError("in takes a literal list")
            found = build(left).isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
            return found | F.lit(None).cast("boolean") if None in values else found
        if op in BINARY:
            left, right = need(node, "left", "right")
            return BINARY[op](build(left), build(right))
        if op == "func":
            name = str(need(node, "name")[0]).lower()
            if name not in FUNCTIONS and name not in FORMATTED:
                raise ExpressionError(f"unknown function: {name}")
            return call(name, node.get("args", []))
        if op in FUNCTIONS or op in FORMATTED:
            return call(op, node.get("args", []))
        raise ExpressionError(f"unknown op: {op}")

    return build(tree)
