"""Loading delimited lines of which some do not parse, by minimum-cost error parse.

A line is read by an automaton with four states: at the start of a field, in a plain field, in a quoted field, after
its closing quote. The dynamic programme keeps, per place in the line, state and number of fields begun, the cheapest
way to get there, where a quote or a delimiter may be deleted or inserted anywhere, each at cost 1. A line of cost 0
has the declared number of fields and sound quoting and loads if its values fit; the edits of any other line name what
is wrong.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The ranges of the integer types.
RANGES = {
    "Int32": (-(2**31), 2**31 - 1),
    "UInt32": (0, 2**32 - 1),
    "Int64": (-(2**63), 2**63 - 1),
    "UInt64": (0, 2**64 - 1),
    "ID": (0, 2**63 - 1),
}
SPARK_TYPES = {"Int32": "int", "UInt32": "bigint", "Int64": "bigint", "UInt64": "decimal(20,0)", "ID": "bigint", "Double": "double", "Date": "date", "DateTime": "timestamp", "String": "string", "LCString": "string"}
_INTEGER = re.compile(r"-?[0-9]+")
_DOUBLE = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_DATETIME = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})\.[0-9]{3}\+0000")


def _real_date(text: str) -> bool:
    try:
        dt.date.fromisoformat(text)
    except ValueError:
        return False
    return True


def fits(value: str, quoted: bool, kind: str) -> bool:
    """Whether a field fits its type. An unquoted empty field is null, which fits all types but ID."""
    if value == "" and not quoted:
        return kind != "ID"
    if kind in RANGES:
        low, high = RANGES[kind]
        digits = value.lstrip("-").lstrip("0")
        return bool(_INTEGER.fullmatch(value)) and len(digits) <= 20 and low <= int(value[:1] * value.startswith("-") + (digits or "0")) <= high
    if kind == "Double":
        return bool(_DOUBLE.fullmatch(value))
    if kind == "Date":
        return bool(_DATE.fullmatch(value)) and _real_date(value)
    if kind == "DateTime":
        m = _DATETIME.fullmatch(value)
        return bool(m) and _real_date(m[1]) and int(m[2]) < 24 and int(m[3]) < 60 and int(m[4]) < 60
    return True


def _tokens(line: str, delim: str) -> list[tuple[int, str, str]]:
    """Quotes, delimiters and runs of other characters, as (position, kind, text)."""
    out, last = [], 0
    for m in re.finditer('"|' + re.escape(delim), line):
        if m.start() > last:
            out.append((last, "o", line[last : m.start()]))
        out.append((m.start(), "q" if m[0] == '"' else "d", m[0]))
        last = m.end()
    if last < len(line):
        out.append((last, "o", line[last:]))
    return out


#: The automaton of sound lines: state -> state by kind of token; a delimiter leads to the next field unless it is quoted.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
_NEXT = {
    "q": (_QUOTED, _PLAIN, _CLOSED, _QUOTED),
    "d": (_START, _START, _QUOTED, _START),
    "o": (_PLAIN, _PLAIN, _QUOTED, None),
}


def error_parse(line: str, delim: str, fields: int | None) -> tuple[int, list[tuple[int, str]]]:
    """Cheapest edits under which `line` has sound quoting and `fields` fields (None: any number): (cost, [(position, edit)]).

    Edits are delete_quote, insert_quote, delete_delim and insert_delim, at cost 1 each and at any place. Of equally cheap
    repairs one is given, always the same, and rather a late one. Cells of the programme are (tokens read, state, fields begun). They are
    filled in the order of their cost plus the delimiters that must still be inserted as too few are left, so that a
    sound line fills one cell per token and a line of cost c only cells that a repair of cost c might pass.
    """
    tokens = _tokens(line, delim)
    n = len(tokens)
    left = [0] * (n + 1)  # delimiters from here on
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (tokens[i][1] == "d")
    back: dict[tuple[int, int, int], tuple[tuple[int, int, int] | None, tuple[int, str] | None]] = {}
    todo: dict[int, list] = {}  # cost and what must still be inserted -> (cell, cost, cell before, edit)

    def reach(cell: tuple[int, int, int], cost: int, before: tuple[int, int, int] | None, edit: tuple[int, str] | None) -> None:
        if cell not in back:
            short = 0 if fields is None else max(0, fields - cell[2] - left[cell[0]])
            todo.setdefault(cost + short, []).append((cell, cost, before, edit))

    reach((0, _START, 1), 0, None, None)
    while True:
        total = min(todo)
        todo[total].reverse()  # repairs late in the line come first
        filled = []  # cells whose edits are still to be tried: only once nothing is left that costs no more
        while todo[total] or filled:
            if not todo[total]:
                cell, cost = filled.pop()
                i, state, f = cell
                at, kind = tokens[i][:2] if i < n else (len(line), "")
                if state != _PLAIN:
                    reach((i, _NEXT["q"][state], f), cost + 1, cell, (at, "insert_quote"))
                if kind == "q":
                    reach((i + 1, state, f), cost + 1, cell, (at, "delete_quote"))
                elif kind == "d":
                    reach((i + 1, state, f), cost + 1, cell, (at, "delete_delim"))
                if state != _QUOTED and (fields is None or f < fields):
                    reach((i, _START, f if fields is None else f + 1), cost + 1, cell, (at, "insert_delim"))
                continue
            cell, cost, before, edit = todo[total].pop()
            while cell not in back:
                back[cell] = (before, edit)
                filled.append((cell, cost))
                i, state, f = cell
                if i == n:
                    if state != _QUOTED and (fields is None or f == fields):
                        return cost, _edits(back, cell)
                    break
                kind = tokens[i][1]
                nxt = _NEXT[kind][state]
                if kind == "d" and state != _QUOTED and fields is not None:
                    f += 1
                if nxt is None or (fields is not None and f > fields):
                    break
                before, edit, cell = cell, None, (i + 1, nxt, f)
                if fields is not None and cost + max(0, fields - f - left[i + 1]) > total:
                    reach(cell, cost, before, None)
                    break
        del todo[total]


def _edits(back: dict, cell: tuple[int, int, int]) -> list[tuple[int, str]]:
    out = []
    while cell is not None:
        cell, edit = back[cell]
        if edit:
            out.append(edit)
    return out[::-1]


def split_sound(line: str, delim: str) -> list[tuple[str, bool]]:
    """The fields of a line of cost 0 as (value, quoted)."""
    out, state, text = [], _START, []
    for _, kind, part in _tokens(line, delim):
        if kind == "d" and state != _QUOTED:
            out.append(("".join(text), state == _CLOSED))
            state, text = _START, []
            continue
        if kind != "q" or state in (_PLAIN, _CLOSED):  # a quote after a closed one stands for itself
            text.append(part)
        state = _NEXT[kind][state]
    out.append(("".join(text), state == _CLOSED))
    return out


def check_line(line: str | None, delim: str | None, kinds: list[str]) -> tuple[str | None, int, list[tuple[int, str]], list[str | None]]:
    """(reason or None, cost, edits, values) of one line; one trailing carriage return is not part of it.

    Reasons in order: quoting, if the programme finds no way without edits through the line, whatever the number of
    fields; column_count, if it finds none with the declared number; value. Cost and edits are those of the cheapest
    repair to the declared number. A null line, or one of a file whose layout is unknown, has the reason column_count:
    there is nothing to fill the columns from.
    """
    if line is None or not kinds or not delim:
        return "column_count", len(kinds), [], []
    line = line[:-1] if line.endswith("\r") else line
    cost, edits = error_parse(line, delim, len(kinds))
    if cost:
        return ("quoting" if error_parse(line, delim, None)[0] else "column_count"), cost, edits, []
    found = split_sound(line, delim)
    bad = [i for i, ((v, q), k) in enumerate(zip(found, kinds)) if not fits(v, q, k)]
    if bad:
        return "value", 0, [(i, "value") for i in bad], []
    return None, 0, [], [None if v == "" and not q else v for v, q in found]


def parse_lines(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Every line with its verdict: `row_id, file_id, line_no, reason, cost, edits, row_values`.

    `reason` is null for lines that load; `edits` is JSON, a list of [position, edit], for values of [column, "value"].
    `row_values` are the field texts in column order (null where null). Lines of unknown files get column_count.
    Repeated rows each get their verdict. The files table has one row per file and is joined by file_id; lines of one
    large file may be split over tasks.
    """
    layout = files.select(F.col("file_id").alias("_file"), F.col("columns").alias("_columns"), F.col("delim").alias("_delim")).dropDuplicates(["_file"])
    joined = rows.select("row_id", "file_id", "line_no", "line").join(layout, F.col("file_id") == F.col("_file"), "left").drop("_file")
    schema = "row_id long, file_id long, line_no int, reason string, cost int, edits string, row_values array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for line, columns, delim in zip(b["line"], b["_columns"], b["_delim"]):
                kinds = columns.split("|") if isinstance(columns, str) and columns else []
                reason, cost, edits, values = check_line(line if isinstance(line, str) else None, delim if isinstance(delim, str) else None, kinds)
                out.append((reason, cost, json.dumps(edits) if edits else None, values if reason is None else None))
            got = pd.DataFrame(out, columns=["reason", "cost", "edits", "row_values"], index=b.index)
            yield pd.concat([b[["row_id", "file_id", "line_no"]], got], axis=1)

    return joined.mapInPandas(run, schema)


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that fail, with the first reason that applies."""
    return parsed.where("reason is not null").select("row_id", "reason")


def typed_table(parsed: DataFrame, header: str, columns: str, file_ids: list[int] | None = None) -> DataFrame:
    """The valid lines of files with one layout as typed columns, by a projection over the parsed values.

    Clashing header names get the suffix _2, _3 and so on.
    """
    good = parsed.where("reason is null")
    if file_ids is not None:
        good = good.where(F.col("file_id").isin(file_ids))
    seen: dict[str, int] = {}
    out = [F.col("row_id"), F.col("file_id"), F.col("line_no")]
    for i, (name, kind) in enumerate(zip(header.split("|"), columns.split("|"))):
        seen[name] = seen.get(name, 0) + 1
        value = F.get("row_values", F.lit(i))
        if kind == "DateTime":
            value = F.to_timestamp(value, "yyyy-MM-dd'T'HH:mm:ss.SSSxx")
        out.append(value.cast(SPARK_TYPES.get(kind, "string")).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return good.select(*out)
