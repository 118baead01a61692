"""Name an intermediate value inside one expression.

Reusing a Python ``Column`` copies its whole tree at every use. ``let`` evaluates it
once and hands the body a variable, so composed expressions stay linear in size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(*args) -> Column:
    """``let(a, b, lambda a, b: ...)``: bind each column once, evaluate the body."""
    *cols, body = args
    cols_t: tuple[Column, ...] = tuple(cols)
    fn: Callable[..., Column] = body
    if len(cols_t) == 1:
        return F.transform(F.array(cols_t[0]), lambda x: fn(x)).getItem(0)
    packed = F.struct(*[c.alias(f"f{i}") for i, c in enumerate(cols_t)])
    return F.transform(F.array(packed), lambda s: fn(*[s[f"f{i}"] for i in range(len(cols_t))])).getItem(0)


def whole_number(text: Column, dtype: str = "long") -> Column:
    """Unsigned digits as a number, NULL otherwise. The shape test comes first because a
    failing cast is caught as an exception, which costs far more than a pattern."""
    width = 9 if dtype == "int" else 18
    return F.when(text.rlike("^[0-9]{1,%d}$" % width), text.cast(dtype))


def decimal_number(text: Column) -> Column:
    return F.when(text.rlike("^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"), text.cast("double"))


def trim_ws(col: Column | str) -> Column:
    """Trim every ASCII white-space character, not blanks only."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\n\r\x0b\x0c"))


def fenced(col: Column) -> Column:
    """The same value, but filters on it stay above the projection that computes it.

    The optimizer moves a filter below a projection by copying the expression into the
    filter, so a costly parse would run once for the test and again for the value. It
    leaves an expression alone that it may not evaluate twice, which the always-true
    row-number test makes of this one.
    """
    return F.when(F.monotonically_increasing_id() >= 0, col)
