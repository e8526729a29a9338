"""Array functions whose lambda is given as SQL text over ``t``.

A word list inside a Python lambda costs one literal object per word each time a plan is
built; as text it is parsed once by the engine and becomes the same hashed set.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(words: Iterable[str], name: str = "t") -> str:
    """``name IN (...)``; an empty list gives false."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in dict.fromkeys(words))
    return f"({name} IN ({quoted}))" if quoted else "false"


def keep(array: Column, condition: str) -> Column:
    return F.call_function("filter", array, F.expr(f"t -> {condition}"))


def any_of(array: Column, condition: str) -> Column:
    return F.call_function("exists", array, F.expr(f"t -> {condition}"))


def change(array: Column, value: str) -> Column:
    return F.call_function("transform", array, F.expr(f"t -> {value}"))


def total(array: Column, value: str) -> Column:
    """Sum of a double per element, added in array order."""
    return F.call_function("aggregate", array, F.lit(0.0), F.expr(f"(acc, t) -> acc + {value}"))
