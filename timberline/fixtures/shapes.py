"""Line shapes: how a row of a table is written as a raw log line.

A shape is text with ``{field}`` marks and ``[[optional parts]]``.  Each field
has an SQL expression over the table's columns that means the same to Spark and
DuckDB.  Spark uses it to write the line; the expected value of a field is the
expression itself, so no expected value ever passes through a regex.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.extract import quoted

_MARK = re.compile(r"\[\[(.*?)\]\]|\{(\w+)\}")


def text(expression: object) -> str:
    """SQL for the text of a number."""
    return f"cast({expression} as string)"


def one_of(selector: str, values: Sequence[str]) -> str:
    """SQL that picks one literal by a number 0, 1, ..."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {selector} {whens} END)"


def _written(shape: str, fields: Mapping[str, str], optional: str) -> str:
    """Spark SQL that writes a shape."""
    out, at = [], 0
    for m in _MARK.finditer(shape):
        if m.start() > at:
            out.append(quoted(shape[at : m.start()]))
        if m[1] is not None:
            out.append(f"(CASE WHEN {optional} THEN {_written(m[1], fields, optional)} ELSE '' END)")
        else:
            out.append(fields[m[2]])
        at = m.end()
    if at < len(shape):
        out.append(quoted(shape[at:]))
    return " || ".join(out)


@dataclass
class Shapes:
    """Alternatives picked by ``selector`` (0, 1, ...); optional parts by ``optional``.

    Each alternative is a shape, or a shape with its own field expressions.
    """

    selector: str
    optional: str
    common: dict[str, str]
    alternatives: list[str | tuple[str, dict[str, str]]]
    _parsed: list[tuple[str, dict[str, str]]] = field(init=False)

    def __post_init__(self) -> None:
        self._parsed = [
            (a, dict(self.common)) if isinstance(a, str) else (a[0], {**self.common, **a[1]}) for a in self.alternatives
        ]

    def line(self) -> Column:
        whens = [f"WHEN {i} THEN {_written(*parsed, self.optional)}" for i, parsed in enumerate(self._parsed)]
        return F.expr(f"CASE {self.selector} {' '.join(whens)} END")

    def expected(self, name: str, cast: str = "string", absent: Sequence[str] = ("",)) -> str:
        """DuckDB SQL for the value a parser has to find in field ``name``."""
        whens = []
        for i, (shape, fields) in enumerate(self._parsed):
            plain = re.sub(r"\[\[.*?\]\]", "", shape)
            if f"{{{name}}}" in plain:
                whens.append(f"WHEN {i} THEN {fields[name]}")
            elif f"{{{name}}}" in shape:
                whens.append(f"WHEN {i} THEN (CASE WHEN {self.optional} THEN {fields[name]} END)")
        if not whens:
            return f"cast(NULL as {cast})"
        value = f"CASE {self.selector} {' '.join(whens)} END"
        return f"cast({value} as {cast})"
