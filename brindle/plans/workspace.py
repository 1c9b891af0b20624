"""Tables that can be changed: typed snapshots in Parquet, with constraints and schema changes.

Every change builds the table's next state as a DataFrame, writes it as a new
snapshot, tests all constraints on what was written and only then points the
catalog to it; a change that fails leaves the table as it was. INSERT writes and
tests the new rows only, as one more snapshot beside the others. Queries are Spark's
own, over views of the current snapshots; ``vacuum`` deletes the others.

A hidden column keeps the order of insertion.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.types import parse_type
from brindle.operators import violations
from brindle.sources import csv
from brindle.sources.catalog import Catalog, Column, Table

ROW_ID = "_row_id"


class ConstraintError(ValueError):
    """A change would break a constraint; nothing was changed."""


def check_condition(check: str, columns: Iterable[str]) -> SparkColumn:
    """A CHECK's text as a condition. Bare words that name no column are texts."""
    known = {c.lower() for c in columns} | {"and", "or", "not", "in", "between", "is", "null", "true", "false", "like"}
    text = lambda m: m[0] if m[0][0] == "'" or m[0].lower() in known or m[2] else f"'{m[0]}'"
    return F.expr(re.sub(r"('(?:[^']|'')*'|[A-Za-z_]\w*)(\s*\()?", lambda m: text(_Word(m)) + (m[2] or ""), check))


class _Word(tuple):
    """A matched word and what follows it, without the following parenthesis."""

    def __new__(cls, m: re.Match):
        return super().__new__(cls, (m[1], m[1], m[2] if m[1].lower() not in ("in", "and", "or", "not") else None))


def _renamed(check: str, old: str, new: str) -> str:
    return re.sub(r"'(?:[^']|'')*'|[A-Za-z_]\w*", lambda m: new if m[0].lower() == old.lower() else m[0], check)


def _mentions(check: str, column: str) -> bool:
    return any(w.lower() == column.lower() for w in re.findall(r"'(?:[^']|'')*'|[A-Za-z_]\w*", check))


class Workspace:
    """A folder of tables. ``semantics`` "compat" lets checks fail on null, as a two-valued engine does."""

    def __init__(self, spark: SparkSession, root: str, semantics: str = "ansi"):
        self.spark, self.semantics = spark, semantics
        self.catalog = Catalog(spark, root)
        for t in self.catalog.tables.values():
            self._publish(t)

    # Reading

    def _stored(self, t: Table) -> DataFrame:
        return self.spark.read.schema(self._schema(t)).parquet(*t.snapshots)

    @staticmethod
    def _schema(t: Table) -> T.StructType:
        return T.StructType([*[T.StructField(c.name, c.logical.spark) for c in t.columns], T.StructField(ROW_ID, T.LongType())])

    def _publish(self, t: Table) -> None:
        self._stored(t).drop(ROW_ID).createOrReplaceTempView(t.name)

    def table(self, name: str) -> DataFrame:
        return self._stored(self.catalog.get(name)).drop(ROW_ID)

    def tables(self) -> dict[str, int]:
        """Names and how many columns each has."""
        return {t.name: len(t.columns) for t in self.catalog.tables.values()}

    def first_rows(self, name: str, keys: Sequence[str]) -> DataFrame:
        """The first inserted row of each group."""
        df = self._stored(self.catalog.get(name))
        rest = [c for c in df.columns if c not in (*keys, ROW_ID)]
        return df.groupBy(*keys).agg(*[F.min_by(c, ROW_ID).alias(c) for c in rest])

    # Changing

    def _commit(self, t: Table, df: DataFrame, added: bool = False) -> None:
        """Write, test, then point the catalog to the new snapshot; ``added``: the table's rows stay, these are new."""
        old = self._stored(t) if added else None
        path = self.catalog.new_snapshot(t.name)
        df.select(*t.names, ROW_ID).write.parquet(path)
        self._validate(t, self.spark.read.schema(self._schema(t)).parquet(path), old)
        t.snapshots = [*t.snapshots, path] if added else [path]
        self._point(t)

    def _point(self, *tables: Table) -> None:
        before = dict(self.catalog.tables)
        self.catalog.tables.update({t.name.lower(): t for t in tables})
        try:
            self.catalog.save()
        except Exception:
            self.catalog.tables = before
            raise
        for t in tables:
            self._publish(t)

    def vacuum(self) -> int:
        return self.catalog.vacuum()

    def _validate(self, t: Table, df: DataFrame, old: DataFrame | None = None) -> None:
        """Test ``df``; with ``old``, rows that were tested before, beside which they are new."""
        required = {c.name for c in t.columns if c.not_null} | set(t.primary_key)
        rules = {f"{c} must not be null": F.col(c).isNull() for c in sorted(required)}
        for check in [c.check for c in t.columns if c.check] + t.checks:
            rules[f"CHECK ({check})"] = ~F.coalesce(check_condition(check, t.names), F.lit(self.semantics != "compat"))
        for c in t.columns:
            if c.logical.name in ("VARCHAR", "ENUM"):
                rules[f"{c.name} must be {c.type}"] = c.logical.rejects(F.col(c.name))
        if rules:  # one pass for all rules on single rows
            broken = df.agg(*[F.count_if(rule).alias(f"r{k}") for k, rule in enumerate(rules.values())]).first()
            for (what, _), n in zip(rules.items(), broken, strict=True):
                if n:
                    raise ConstraintError(f"{t.name}: {what} ({n} rows)")
        keys = [(c.name,) for c in t.columns if c.unique] + ([tuple(t.primary_key)] if t.primary_key else [])
        for key in keys:
            met = old is not None and not df.join(old.select(*key), list(key), "left_semi").isEmpty()
            if met or not violations.duplicate_keys(df, *key).isEmpty():
                raise ConstraintError(f"{t.name}: ({', '.join(key)}) must be unique")
        for c in t.columns:
            if c.references:
                parent, column = c.references.split(".")
                own = df if old is None else old.unionByName(df)
                rows = own if parent.lower() == t.name.lower() else self._stored(self.catalog.get(parent))
                if not violations.orphans(df, c.name, rows, column).isEmpty():
                    raise ConstraintError(f"{t.name}: {c.name} has values without a row in {c.references}")

    def _restrict(self, t: Table, after: DataFrame) -> None:
        """No row of another table, or of this one, may lose the row it refers to."""
        for other in self.catalog.tables.values():
            for c in other.columns:
                if c.references and c.references.split(".")[0].lower() == t.name.lower():
                    rows = after if other.name == t.name else self._stored(other)
                    if not violations.orphans(rows, c.name, after, c.references.split(".")[1]).isEmpty():
                        raise ConstraintError(f"{t.name}: rows that {other.name}.{c.name} refers to cannot go")

    def create_table(self, name: str, columns: Sequence[Column], primary_key: Sequence[str] = (), checks: Sequence[str] = (), if_not_exists: bool = False) -> None:
        if name.lower() in self.catalog.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        for c in columns:
            c.type = str(c.logical)
        t = Table(name, list(columns), list(primary_key), list(checks))
        for c in (*primary_key, *[c.name for c in columns]):
            t.column(c)
        if len({c.name.lower() for c in columns}) < len(columns):
            raise ValueError("column names must differ")
        for c in t.columns:
            if c.references:
                parent, column = c.references.split(".")
                (t if parent.lower() == name.lower() else self.catalog.get(parent)).column(column)
        self._commit(t, self.spark.createDataFrame([], self._schema(t)))

    def import_csv(self, name: str, path: str) -> None:
        """A table from a CSV file: integers or texts by what the columns hold, a unique ``id`` being the key. If there is
        a table of the name, the file's header must be its columns, and the file's rows take the place of its rows."""
        texts = csv.read_text(self.spark, path)
        known = copy.deepcopy(self.catalog.tables.get(name.lower()))
        if known and [c.lower() for c in texts.columns] != [c.lower() for c in known.names]:
            raise ValueError(f"{path} has columns {', '.join(texts.columns)}; {known.name} has {', '.join(known.names)}")
        copy_path = self.catalog.new_snapshot(name)  # the file's rows are read once, all else uses this table
        numbered = texts.withColumn(ROW_ID, F.monotonically_increasing_id())
        numbered.write.parquet(copy_path)
        numbered = self.spark.read.schema(numbered.schema).parquet(copy_path)
        if known:
            after = self._typed(known, numbered, texts.columns, [ROW_ID])
            self._restrict(known, after)
            self._commit(known, after)
            return
        texts = numbered.drop(ROW_ID)
        types = csv.infer_types(texts)
        t = Table(name, [Column(c, str(kind)) for c, kind in types.items()])
        typed = self._typed(t, numbered, texts.columns, [ROW_ID])
        if "id" in texts.columns and typed.where("id is null").isEmpty() and violations.duplicate_keys(typed, "id").isEmpty():
            t.primary_key = ["id"]
        self._commit(t, typed)

    def import_folder(self, path: str) -> list[str]:
        """A table from each CSV file of a folder that has none yet, by the file's name; the names of the new tables."""
        new = []
        for name, file in csv.files(self.spark, path):
            if name.lower() not in self.catalog.tables:
                self.import_csv(name, file)
                new.append(name)
        return new

    def export_csv(self, name: str, path: str) -> None:
        csv.write_text(self._stored(self.catalog.get(name)).orderBy(ROW_ID).drop(ROW_ID), path)

    def _typed(self, t: Table, rows: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """``rows``, whatever their types, as columns of the table, then those to ``keep``; a value that its type rejects
        is an error."""
        texts = rows.toDF(*names, *keep).select(*[F.col(c).cast("string").alias(c) for c in names], *keep)
        bad = texts.agg(*[F.count_if(t.column(c).logical.rejects(F.col(c))).alias(c) for c in names]).first()
        for c in names:
            if bad[c]:
                raise ConstraintError(f"{t.name}: {c} has {bad[c]} values that are not {t.column(c).type}")
        given = {t.column(c).name: t.column(c).logical.value(F.col(c)) for c in names}
        return texts.select(*[given.get(c.name, F.lit(None)).cast(c.logical.spark).alias(c.name) for c in t.columns], *keep)

    def insert(self, name: str, rows: DataFrame | Sequence[Sequence[Any]], columns: Sequence[str] | None = None) -> None:
        t = copy.deepcopy(self.catalog.get(name))
        names = [t.column(c).name for c in columns] if columns else t.names
        if not isinstance(rows, DataFrame):
            if any(len(r) != len(names) for r in rows):
                raise ValueError(f"{name} takes {len(names)} values a row")
            texts = [[None if v is None else str(v) for v in r] for r in rows]
            rows = self.spark.createDataFrame(texts, T.StructType([T.StructField(c, T.StringType()) for c in names]))
        if len(rows.columns) != len(names):
            raise ValueError(f"{name} takes {len(names)} values a row")
        old = self._stored(t)
        last = old.agg(F.max(ROW_ID)).first()[0]
        added = self._typed(t, rows, names).withColumn(ROW_ID, F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
        self._commit(t, added, added=True)

    def update(self, name: str, values: Mapping[str, SparkColumn | str | None], where: SparkColumn | str | None = None) -> None:
        """Set columns to expressions of the old row's values, in rows where the condition is true."""
        t = copy.deepcopy(self.catalog.get(name))
        old = self._stored(t)
        hit = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        new = {t.column(c).name: F.lit(v) if v is None else F.expr(v) if isinstance(v, str) else v for c, v in values.items()}
        for c, kind in old.select(*[v.alias(c) for c, v in new.items()]).dtypes:
            if kind == "boolean" and t.column(c).logical.name != "BOOLEAN":  # a truth value is 1 or 0 elsewhere
                new[c] = new[c].cast("int")
        texts = old.where(hit).select(*[v.cast("string").alias(c) for c, v in new.items()])
        self._typed(t, texts, list(new))  # rejects what a type does not take
        kept = [F.when(hit, t.column(c).logical.value(new[c].cast("string"))).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in t.names]
        after = old.select(*kept, ROW_ID)
        self._restrict(t, after)
        self._commit(t, after)

    def delete(self, name: str, where: SparkColumn | str | None = None) -> None:
        t = copy.deepcopy(self.catalog.get(name))
        hit = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        after = self._stored(t).where(~hit)
        self._restrict(t, after)
        self._commit(t, after)

    # Schema changes

    def add_column(self, name: str, column: Column) -> None:
        t = copy.deepcopy(self.catalog.get(name))
        old = self._stored(t)
        if column.name.lower() in [c.lower() for c in t.names]:
            raise ValueError(f"{name} has a column {column.name}")
        if column.not_null and not old.isEmpty():
            raise ConstraintError(f"{name} has rows, so {column.name} cannot be NOT NULL")
        column.type = str(column.logical)
        t.columns.append(column)
        self._commit(t, old.withColumn(column.name, F.lit(None).cast(column.logical.spark)))

    def drop_column(self, name: str, column: str) -> None:
        t = copy.deepcopy(self.catalog.get(name))
        c = t.column(column)
        referred = [f"{o.name}.{x.name}" for o in self.catalog.tables.values() for x in o.columns if (x.references or "").lower() == f"{t.name}.{c.name}".lower()]
        checks = [*t.checks, *[x.check for x in t.columns if x.check and x.name != c.name]]
        if len(t.columns) == 1 or c.name in t.primary_key or referred or any(_mentions(x, c.name) for x in checks):
            raise ConstraintError(f"{name}.{column} is in use or the last column")
        t.columns.remove(c)
        self._commit(t, self._stored(self.catalog.get(name)).drop(c.name))

    def rename_column(self, name: str, old: str, new: str) -> None:
        tables = copy.deepcopy(self.catalog.tables)  # those that refer to the column change too, or none does
        t = tables[self.catalog.get(name).name.lower()]
        c = t.column(old)
        if not re.fullmatch(r"[A-Za-z_]\w*", new):
            raise ValueError(f"not a column name: {new}")
        if new.lower() in [x.lower() for x in t.names]:
            raise ValueError(f"{name} has a column {new}")
        before = c.name
        df = self._stored(t).withColumnRenamed(before, new)
        c.name = new
        t.primary_key = [new if k == before else k for k in t.primary_key]
        t.checks = [_renamed(x, before, new) for x in t.checks]
        changed = []
        for other in tables.values():
            for x in other.columns:
                if (x.references or "").lower() == f"{t.name}.{before}".lower():
                    x.references = f"{t.name}.{new}"
                    changed.append(other)
                if other is t and x.check:
                    x.check = _renamed(x.check, before, new)
        path = self.catalog.new_snapshot(t.name)
        df.select(*t.names, ROW_ID).write.parquet(path)
        t.snapshots = [path]
        self._point(t, *[o for o in changed if o is not t])

    def alter_type(self, name: str, column: str, kind: str) -> None:
        t = copy.deepcopy(self.catalog.get(name))
        old = self._stored(t)
        c = t.column(column)
        c.type = str(parse_type(kind))
        ids = old.select(F.col(c.name).cast("string").alias(c.name))
        self._typed(t, ids, [c.name])
        self._commit(t, old.withColumn(c.name, c.logical.value(F.col(c.name).cast("string")).cast(c.logical.spark)))

    def add_constraint(self, name: str, primary_key: Sequence[str] = (), unique: Sequence[str] = (), foreign_key: tuple[str, str] | None = None, check: str | None = None) -> None:
        """Add constraints, tested on the rows there are. ``foreign_key``: (column, "table.column")."""
        t = copy.deepcopy(self.catalog.get(name))
        if primary_key:
            if t.primary_key:
                raise ValueError(f"{name} has a primary key")
            t.primary_key = [t.column(c).name for c in primary_key]
        for c in unique:
            t.column(c).unique = True
        if foreign_key:
            parent, column = foreign_key[1].split(".")
            target = t if parent.lower() == t.name.lower() else self.catalog.get(parent)
            t.column(foreign_key[0]).references = f"{target.name}.{target.column(column).name}"
        if check:
            t.checks.append(check)
        self._validate(t, self._stored(t))
        self._point(t)
