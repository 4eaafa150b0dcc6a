"""Checks of worked mathematics examples with exact rational numbers.

An expression is parsed to Python's syntax tree and evaluated over fractions,
polynomials in one variable, or, for trigonometry and roots, numbers with a
tolerance.  What this can't decide is ``UNVERIFIED``, never passed.
"""

from __future__ import annotations

import ast
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

PASS, FAIL, UNVERIFIED = "PASS", "FAIL", "UNVERIFIED"
#: A polynomial: coefficients from the constant term on.
Poly = list[Fraction]
MOST_DEGREE = 200


class Undecided(Exception):
    """The expression lies outside what is decided exactly."""


def _tidy(p: Poly) -> Poly:
    while len(p) > 1 and p[-1] == 0:
        p = p[:-1]
    return p or [Fraction(0)]


def add(a: Poly, b: Poly) -> Poly:
    n = max(len(a), len(b))
    return _tidy([(a[i] if i < len(a) else Fraction(0)) + (b[i] if i < len(b) else Fraction(0)) for i in range(n)])


def times(a: Poly, b: Poly) -> Poly:
    if len(a) + len(b) > MOST_DEGREE:
        raise Undecided
    out = [Fraction(0)] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return _tidy(out)


def polynomial(text: str | None, variable: str = "x") -> Poly:
    """The polynomial that an expression is; Undecided for anything else."""
    source = (text or "").replace("^", "**").replace("−", "-").replace("·", "*").strip()
    try:
        tree = ast.parse(source, mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise Undecided from e

    def walk(n: ast.expr) -> Poly:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return [Fraction(str(n.value))]
        if isinstance(n, ast.Name) and n.id == variable:
            return [Fraction(0), Fraction(1)]
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            p = walk(n.operand)
            return [-c for c in p] if isinstance(n.op, ast.USub) else p
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            if isinstance(n.op, ast.Add):
                return add(a, b)
            if isinstance(n.op, ast.Sub):
                return add(a, [-c for c in b])
            if isinstance(n.op, ast.Mult):
                return times(a, b)
            if isinstance(n.op, ast.Div) and len(b) == 1 and b[0] != 0:
                return [c / b[0] for c in a]
            if isinstance(n.op, ast.Pow) and len(b) == 1 and b[0].denominator == 1 and 0 <= b[0] <= MOST_DEGREE:
                out = [Fraction(1)]
                for _ in range(int(b[0])):
                    out = times(out, a)
                return out
        raise Undecided

    return walk(tree)


def value(p: Poly, x: Fraction) -> Fraction:
    """A polynomial's value, by Horner."""
    out = Fraction(0)
    for c in reversed(p):
        out = out * x + c
    return out


def derivative(p: Poly) -> Poly:
    return _tidy([c * i for i, c in enumerate(p)][1:])


def integral(p: Poly) -> Poly:
    return [Fraction(0), *(c / (i + 1) for i, c in enumerate(p))]


def _number(text: str | None) -> Fraction:
    p = polynomial(text)
    if len(p) != 1:
        raise Undecided
    return p[0]


def rational_roots(p: Poly) -> list[Fraction]:
    """All real roots with their values if all are rational; Undecided otherwise (degree 2 at most)."""
    p = _tidy(p)
    if len(p) == 1:
        raise Undecided
    if len(p) == 2:
        return [-p[0] / p[1]]
    if len(p) > 3:
        raise Undecided
    c, b, a = p
    d = b * b - 4 * a * c
    if d < 0:
        return []
    root = Fraction(math.isqrt(d.numerator), math.isqrt(d.denominator))
    if root * root != d:
        raise Undecided
    return sorted({(-b - root) / (2 * a), (-b + root) / (2 * a)})


def _listed(text: str | None) -> list[Fraction]:
    inner = (text or "").strip().strip("[]{}()")
    return sorted({_number(x) for x in inner.replace(";", ",").split(",") if x.strip()})


def _trig(text: str | None) -> float:
    source = (text or "").replace("π", "pi").replace("√", "sqrt").replace("^", "**").replace("°", "*pi/180")
    names = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "sqrt": math.sqrt, "pi": math.pi}

    def walk(n: ast.expr) -> float:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return float(n.value)
        if isinstance(n, ast.Name) and n.id == "pi":
            return math.pi
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            for kind, do in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: a / b), (ast.Pow, lambda: a**b)):
                if isinstance(n.op, kind):
                    return do()
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in names and len(n.args) == 1 and not n.keywords:
            return names[n.func.id](walk(n.args[0]))
        raise Undecided

    return walk(ast.parse(source.strip(), mode="eval").body)


def _verdict(ok: bool) -> str:
    return PASS if ok else FAIL


def review(check: dict) -> str:
    """PASS, FAIL or UNVERIFIED of one example: ``type`` and the fields it needs, all strings or null."""
    kind, x = check.get("type"), check.get("variable") or "x"
    get = check.get
    try:
        if kind == "arithmetic":
            return _verdict(_number(get("expression")) == _number(get("expected")))
        if kind == "equation":
            p = add(polynomial(get("expression"), x), [-c for c in polynomial(get("rhs") or "0", x)])
            return _verdict(rational_roots(p) == _listed(get("expected")))
        if kind == "polynomial_remainder":
            return _verdict(value(polynomial(get("polynomial"), x), _number(get("divisor_root"))) == _number(get("expected")))
        if kind == "function_value":
            return _verdict(value(polynomial(get("expression"), x), _number(get("lower"))) == _number(get("expected")))
        if kind == "function_range":
            p, a, b = polynomial(get("expression"), x), _number(get("lower")), _number(get("upper"))
            slope = derivative(p)
            inner = [r for r in rational_roots(slope) if a < r < b] if len(slope) > 1 else []
            values = [value(p, r) for r in (a, b, *inner)]
            return _verdict([min(values), max(values)] == sorted(_listed(get("expected"))) or (min(values) == max(values) and _listed(get("expected")) == [min(values)]))
        if kind in ("combination", "permutation"):
            n, r = _number(get("lower")), _number(get("upper"))
            if n.denominator != 1 or r.denominator != 1 or not 0 <= r <= n or n > 10_000:
                return UNVERIFIED
            return _verdict((math.comb if kind == "combination" else math.perm)(int(n), int(r)) == _number(get("expected")))
        if kind == "trigonometric_value":
            return _verdict(math.isclose(_trig(get("expression")), _trig(get("expected")), rel_tol=1e-9, abs_tol=1e-9))
        if kind == "distance_2d":
            (a, b), (c, d) = ([_number(v) for v in (get(k) or "").strip("() ").split(",")] for k in ("lower", "upper"))
            return _verdict(math.isclose(math.hypot(a - c, b - d), _trig(get("expected")), rel_tol=1e-9, abs_tol=1e-9))
        if kind == "indefinite_integral":
            return _verdict(derivative(polynomial((get("expected") or "").replace("+ C", "").replace("+C", ""), x)) == _tidy(polynomial(get("expression"), x)))
        if kind == "definite_integral":
            whole = integral(polynomial(get("expression"), x))
            return _verdict(value(whole, _number(get("upper"))) - value(whole, _number(get("lower"))) == _number(get("expected")))
    except (Undecided, ValueError, TypeError, ZeroDivisionError, OverflowError, SyntaxError, AttributeError, RecursionError):
        return UNVERIFIED
    return UNVERIFIED


def reviewed(check: Column) -> Column:
    """:func:`review` of a struct column."""

    def work(checks: pd.DataFrame) -> pd.Series:
        return pd.Series([review({k: v for k, v in row.items() if isinstance(v, str)}) for row in checks.to_dict("records")], dtype=object)

    return pandas_udf(work, T.StringType())(check)
