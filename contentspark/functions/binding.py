"""Local names inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it.

    A column is a tree, so a Python variable used twice is computed twice, and once per element when it
    is used inside a lambda; binding it to a lambda variable avoids both.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(sql: str, /, **arguments: Column) -> Column:
    """A SQL expression over named arguments ``p.<name>``, each computed once per row.

    Long expressions are written as SQL text: the driver sends them to the JVM in one call instead of one call
    per operator.
    """
    row = F.struct(*[value.alias(name) for name, value in arguments.items()])
    return F.get(F.call_function("transform", F.array(row), F.expr(f"p -> {sql}")), F.lit(0))


def let_sql(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``value`` bound to ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(text: str) -> str:
    """A SQL string literal of any text."""
    return "'" + "".join(
        c if c.isalnum() and c.isascii() or c in " .,:;-_<>/()[]{}|*+?^$=#&!@%~" else
        (f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}") for c in text) + "'"
