"""Formulas of constraint laws as column expressions.

A formula is parsed and translated node by node; no text is ever evaluated as code.  Each step carries a value and whether
something has gone wrong; a formula that went wrong anywhere deviates by 1.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Step = tuple[Column, Column]  # value, failed
#: Nodes of a formula at most; a longer one counts as wrong.
MAX_NODES = 500


class _Wrong(Exception):
    """What the language of formulas does not know."""


def _checked(value: Column, failed: Column) -> _Step:
    """A result that is no number, or infinite, is a failure."""
    bad = failed | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value), bad


def _divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, 1.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def _power(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b < 0), None).otherwise(F.pow(F.when((a == 0) & (b < 0), 1.0).otherwise(a), b))


# What formulas may say: operators, functions of one value, functions of several, comparisons as the size of their violation.
_BINARY: dict[type, Callable[[Column, Column], Column]] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _divided, ast.Pow: _power}
_ONE: dict[str, Callable[[Column], Column]] = {"abs": F.abs, "sqrt": lambda x: F.sqrt(F.greatest(F.lit(0.0), x))}
_MANY: dict[str, Callable[..., Column]] = {"min": F.least, "max": F.greatest}
_over = lambda a, b: F.greatest(F.lit(0.0), a - b)
_COMPARED: dict[type, Callable[[Column, Column], Column]] = {ast.Eq: lambda a, b: F.abs(a - b), ast.Lt: _over, ast.LtE: _over, ast.Gt: lambda a, b: _over(b, a), ast.GtE: lambda a, b: _over(b, a)}


def _translate(node: ast.AST, name: Callable[[str], Column]) -> _Step:
    down = lambda x: _translate(x, name)
    if isinstance(node, ast.Constant):
        if not isinstance(node.value, int | float):
            raise _Wrong(node)
        try:
            value = float(node.value)
        except OverflowError:
            raise _Wrong(node) from None
        return F.lit(value), F.lit(not math.isfinite(value))
    if isinstance(node, ast.Name):
        return name(node.id), F.lit(False)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd | ast.USub):
        value, failed = down(node.operand)
        return (-value if isinstance(node.op, ast.USub) else value), failed
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        (a, x), (b, y) = down(node.left), down(node.right)
        return _checked(_BINARY[type(node.op)](a, b), x | y)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        parts = [down(x) for x in node.args]
        failed = reduce(lambda a, b: a | b, (f for _, f in parts), F.lit(False))
        if node.func.id in _ONE and len(parts) == 1:
            return _checked(_ONE[node.func.id](parts[0][0]), failed)
        if node.func.id in _MANY and len(parts) > 1:
            return _checked(_MANY[node.func.id](*(v for v, _ in parts)), failed)
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARED:
        (a, x), (b, y) = down(node.left), down(node.comparators[0])
        return _checked(_COMPARED[type(node.ops[0])](a, b), x | y)
    raise _Wrong(node)


def deviation(formula: str | None, parameters: Column) -> Column:
    """How far ``parameters`` (a map of names to doubles) are from satisfying ``formula``: its absolute value.

    Numbers, ``+ - * / **``, signs, ``abs min max sqrt`` and one comparison, which gives the size of its violation, are known.
    A name is looked up as written, then by its lower case among the lower-cased names, else it is 0, as is a null value.
    ``x / 0`` is 1, the root of a negative number 0.  An empty formula is satisfied (0); one that cannot be parsed, says
    something else, or gives no finite number deviates by 1.
    """
    if formula is None or not formula.strip():
        return F.lit(0.0)
    low = lambda x: F.try_element_at(F.filter(F.map_entries(parameters), lambda e: (F.lower(e["key"]) == x) & e["value"].isNotNull()), F.lit(-1))["value"]
    name = lambda x: F.coalesce(F.try_element_at(parameters, F.lit(x)), low(x.lower()), F.lit(0.0))
    try:
        tree = ast.parse(formula.strip(), mode="eval")
        if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
            return F.lit(1.0)
        value, failed = _translate(tree.body, name)
    except (_Wrong, SyntaxError, ValueError, RecursionError, MemoryError):
        return F.lit(1.0)
    return F.when(failed, 1.0).otherwise(F.abs(value))


def deviations(rows: DataFrame, formulas: DataFrame, most: int = 1_000) -> DataFrame:
    """``rows`` (with a map column ``parameters``) by ``formulas(formula_id, formula)``: one row each, with ``deviation``.

    Formulas are laws, written by people: up to ``most`` of them come to the driver to be compiled, more are an error.
    All are worked out in one pass over the rows.
    """
    listed = formulas.select("formula_id", "formula").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} formulas")
    if not listed:
        return rows.drop("parameters").limit(0).withColumns({"formula_id": F.lit(None).cast(formulas.schema["formula_id"].dataType), "deviation": F.lit(0.0)})
    every = F.array(*(F.struct(F.lit(x.formula_id).alias("formula_id"), deviation(x.formula, F.col("parameters")).alias("deviation")) for x in listed))
    return rows.withColumn("_f", F.explode(every)).select(*(c for c in rows.columns if c != "parameters"), "_f.formula_id", "_f.deviation")
