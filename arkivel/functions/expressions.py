"""The expression language of format descriptions: parsed once, then a Column or a Python function.

or, and, not (looser than comparison), one comparison, + -, * / %, unary minus; whole numbers, 0x numbers, quoted text
and dotted references. Comparison is numeric if both sides are whole numbers, else by text; / truncates toward zero and
% has the sign of the dividend; anything but 0 is true.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>0[xX][0-9a-fA-F]+|\d+)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<ref>[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)|(?P<op><=|>=|!=|[-+*/%()=<>]))")


@cache
def parse(text: str) -> tuple:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = [0]

    def peek() -> tuple[str, str]:
        return tokens[place[0]]

    def take() -> tuple[str, str]:
        place[0] += 1
        return tokens[place[0] - 1]

    def chain(ops: tuple[str, ...], below: Callable[[], tuple]) -> tuple:
        left = below()
        while peek()[1] in ops and peek()[0] in ("op", "ref"):
            left = (take()[1], left, below())
        return left

    def negated() -> tuple:
        if peek() == ("ref", "not"):
            take()
            return ("not", negated())
        left = sums()
        if peek()[0] == "op" and peek()[1] in ("=", "!=", "<", "<=", ">", ">="):
            return (take()[1], left, sums())
        return left

    def sums() -> tuple:
        return chain(("+", "-"), lambda: chain(("*", "/", "%"), unary))

    def unary() -> tuple:
        kind, value = take()
        if (kind, value) == ("op", "-"):
            inner = unary()
            return ("num", -inner[1]) if inner[0] == "num" else ("neg", inner)
        if value == "(" and kind == "op":
            inner = chain(("or",), lambda: chain(("and",), negated))
            if take()[1] != ")":
                raise ValueError("a parenthesis is missing")
            return inner
        if kind == "num":
            return ("num", int(value, 0))
        if kind == "str":
            return ("str", value[1:-1])
        if kind == "ref" and value not in ("and", "or", "not"):
            return ("ref", tuple(value.split(".")))
        raise ValueError(f"unexpected {value!r}")

    tree = chain(("or",), lambda: chain(("and",), negated))
    if peek()[0] != "end":
        raise ValueError(f"unexpected {peek()[1]!r}")
    return tree


def references(tree: tuple) -> set[tuple[str, ...]]:
    if tree[0] == "ref":
        return {tree[1]}
    return set().union(*[references(t) for t in tree[1:] if isinstance(t, tuple)]) if tree[0] not in ("num", "str") else set()


def evaluate(tree: tuple, look: Callable[[tuple[str, ...]], Any]) -> Any:
    op = tree[0]
    if op in ("num", "str"):
        return tree[1]
    if op == "ref":
        return look(tree[1])
    true = lambda v: v not in (0, "", None, False)
    if op in ("or", "and"):
        left = true(evaluate(tree[1], look))
        return int(left or true(evaluate(tree[2], look))) if op == "or" else int(left and true(evaluate(tree[2], look)))
    if op == "not":
        return int(not true(evaluate(tree[1], look)))
    if op == "neg":
        return -evaluate(tree[1], look)
    a, b = evaluate(tree[1], look), evaluate(tree[2], look)
    if op in ("=", "!=", "<", "<=", ">", ">="):
        if not (isinstance(a, int) and isinstance(b, int)):
            a, b = str(a), str(b)
        return int({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    if op in "/%":
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if op == "/" else a - q * b
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def column(tree: tuple, look: Callable[[tuple[str, ...]], tuple[Column, bool]]) -> Column:
    """look: the Column of a reference, and whether it is a whole number. Results are whole numbers or text."""
    return _typed(tree, look)[0]


def _typed(tree: tuple, look) -> tuple[Column, bool]:
    op = tree[0]
    if op == "num":
        return F.lit(tree[1]).cast("bigint"), True
    if op == "str":
        return F.lit(tree[1]), False
    if op == "ref":
        return look(tree[1])
    true = lambda t: F.coalesce((lambda c, whole: c != 0 if whole else c != "")(*_typed(t, look)), F.lit(False))
    whole = lambda c: (c.cast("bigint"), True)
    if op == "or":
        return whole(true(tree[1]) | true(tree[2]))
    if op == "and":
        return whole(true(tree[1]) & true(tree[2]))
    if op == "not":
        return whole(~true(tree[1]))
    if op == "neg":
        return -_typed(tree[1], look)[0], True
    (a, na), (b, nb) = _typed(tree[1], look), _typed(tree[2], look)
    if op in ("=", "!=", "<", "<=", ">", ">="):
        if not (na and nb):
            a, b = a.cast("string"), b.cast("string")
        return whole({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    if op == "/":
        from .values import quotient

        return quotient(a, b), True
    return {"+": a + b, "-": a - b, "*": a * b, "%": a % b}[op], True
