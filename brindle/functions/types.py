"""Logical column types: what they accept, and how text becomes a typed value.

The empty text is null for every type. Text that a type does not accept is
reported, never silently turned into null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Spellings of types and of truth values.
_SPELLINGS = {
    "INT": "INT", "INTEGER": "INT", "TEXT": "TEXT", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "FLOAT": "FLOAT", "REAL": "FLOAT",
    "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "TIMESTAMP": "TIMESTAMP", "VARCHAR": "VARCHAR",
}
TRUE_WORDS, FALSE_WORDS = ("true", "t", "1"), ("false", "f", "0")


@dataclass(frozen=True)
class LogicalType:
    name: str
    length: int | None = None
    values: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.name == "VARCHAR":
            return f"VARCHAR({self.length})"
        if self.name == "ENUM":
            return "ENUM(" + ",".join("'" + v.replace("'", "''") + "'" for v in self.values) + ")"
        return self.name

    @property
    def spark(self) -> T.DataType:
        kinds = {"INT": T.LongType(), "BOOLEAN": T.BooleanType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampNTZType()}
        return kinds.get(self.name, T.StringType())

    def value(self, text: Column) -> Column:
        """The typed value of a text; null where the text is empty or not accepted."""
        trimmed = F.trim(text)
        if self.name == "INT":
            return F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long"))
        if self.name in ("FLOAT", "DOUBLE"):
            return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
        if self.name == "BOOLEAN":
            return F.when(F.lower(trimmed).isin(*TRUE_WORDS), True).when(F.lower(trimmed).isin(*FALSE_WORDS), False)
        if self.name == "TIMESTAMP":
            return F.when(trimmed.rlike(_TIMESTAMP), trimmed.try_cast("timestamp_ntz"))
        if self.name == "VARCHAR":
            return F.when((text != "") & (F.octet_length(text) <= self.length), text)
        if self.name == "ENUM":
            return F.when(text.isin(*self.values), text)
        return F.when(text != "", text)

    def rejects(self, text: Column) -> Column:
        """Whether a text is neither empty nor accepted."""
        return text.isNotNull() & (text != "") & self.value(text).isNull()


def parse_type(text: str) -> LogicalType:
    """The logical type a spelling names; ``ValueError`` for any other."""
    plain = re.sub(r"\s+", " ", text.strip())
    if found := re.fullmatch(r"(?i)enum ?\((.*)\)", plain):
        values = re.findall(r"'((?:[^']|'')*)'", found[1])
        if not values or re.sub(r"'(?:[^']|'')*'", "", found[1]).replace(" ", "") != "," * (len(values) - 1):
            raise ValueError(f"an ENUM needs a list of texts: {text}")
        return LogicalType("ENUM", values=tuple(v.replace("''", "'") for v in values))
    if found := re.fullmatch(r"(?i)varchar ?\( ?(\d+) ?\)", plain):
        if int(found[1]) < 1:
            raise ValueError("a VARCHAR holds at least one byte")
        return LogicalType("VARCHAR", length=int(found[1]))
    name = _SPELLINGS.get(plain.upper())
    if name is None:
        raise ValueError(f"unsupported type: {text}")
    return LogicalType(name, length=255 if name == "VARCHAR" else None)


def supported(text: str) -> bool:
    try:
        parse_type(text)
    except ValueError:
        return False
    return True
