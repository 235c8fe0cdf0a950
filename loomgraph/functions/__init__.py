"""Scalar functions of the query languages, by name, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ";"


def concat(*parts: Column) -> Column:
    """Parts joined by the separator; null if any part is."""
    out = [parts[0].cast("string")]
    for p in parts[1:]:
        out += [F.lit(SEPARATOR), p.cast("string")]
    return F.concat(*out)


def list_size(text: Column) -> Column:
    """Number of items of a joined text; 0 for an empty one."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SEPARATOR)))


def regex_full(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


UNITS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")


def duration(parts: dict[str, Column]) -> Column:
    """An interval from {unit: amount}; milliseconds go into the seconds."""
    args = {u: parts[u] for u in UNITS if u in parts}
    if "milliseconds" in parts:
        args["seconds"] = args.get("seconds", F.lit(0)) + parts["milliseconds"] / F.lit(1000.0)
    names = {"minutes": "mins", "seconds": "secs"}
    return F.make_interval(**{names.get(u, u): a for u, a in args.items()})


EXTRACTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "millisecond": lambda c: (F.unix_millis(c) % 1000).cast("int"),
}

#: User functions of Cypher (the part after the namespace); more can be registered.
SCALARS: dict[str, Callable[..., Column]] = {
    "datetime": lambda ms: F.timestamp_millis(ms.cast("long")),
    "toFloat": lambda x: x.cast("double"),
    "concat": concat,
    "listSize": list_size,
    "first": lambda a: F.element_at(a, 1),
    "second": lambda a: F.element_at(a, 2),
}


def register(name: str, function: Callable[..., Column]) -> None:
    """Makes a Column function (or a pandas UDF) callable as gs.function.<name>."""
    SCALARS[name] = function
