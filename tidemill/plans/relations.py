"""Filters over related tables: paths are outer joins, "some related row" is a semi join, "all of them" an anti join.

A catalog names DataFrames and the relations between them. Predicates are Columns over the related table, or functions
from that table's rows to the rows that satisfy them, or quantifiers, which nest to any depth:

    catalog.exists("customer", "orders", Quantifier("lines", F.col("l_quantity") > 45))

Logic is SQL's: a related row for which a predicate is unknown neither makes "some" true nor "all" false. Catalyst sees
plain joins, so that predicates reach the scans and a small side is broadcast when its statistics allow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pairs = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class OneToMany:
    """Rows of child whose columns equal the parent's; pairs: (parent column, child column)."""

    child: str
    pairs: Pairs


@dataclass(frozen=True)
class ManyToMany:
    """Rows of target reached over a junction; left: (parent, junction) columns, right: (junction, target) columns."""

    junction: str
    left: Pairs
    right: Pairs
    target: str


@dataclass(frozen=True)
class Row:
    """A DataFrame that stands for rows of a table, with the table's relations."""

    table: str
    rows: DataFrame


@dataclass(frozen=True)
class Quantifier:
    """"Some related row along path satisfies predicate", or with every, "all of them do": a predicate for use in another one."""

    path: str
    predicate: Predicate = None
    every: bool = False


Predicate = Column | Callable[[Row], Row] | Quantifier | None


@dataclass
class Catalog:
    tables: dict[str, DataFrame]
    relations: dict[str, dict[str, OneToMany | ManyToMany]] = field(default_factory=dict)

    def __post_init__(self):
        """Relations must name tables and columns that are there."""
        for table, own in self.relations.items():
            for name, r in own.items():
                target = r.child if isinstance(r, OneToMany) else r.target
                for t in {table, target} | ({r.junction} if isinstance(r, ManyToMany) else set()):
                    if t not in self.tables:
                        raise ValueError(f"{table}.{name}: no table {t}")
                steps = [(table, target, r.pairs)] if isinstance(r, OneToMany) else [(table, r.junction, r.left), (r.junction, target, r.right)]
                for a, b, pairs in steps:
                    missing = [c for x, y in pairs for t, c in ((a, x), (b, y)) if c not in self.tables[t].columns]
                    if missing:
                        raise ValueError(f"{table}.{name}: no column {', '.join(missing)}")

    def rows(self, of: str | Row) -> Row:
        """The rows of a table, or those given."""
        if isinstance(of, Row):
            return of
        if of not in self.tables:
            raise ValueError(f"no table {of}")
        return Row(of, self.tables[of])

    def where(self, of: str | Row, test: Column) -> Row:
        own = self.rows(of)
        return Row(own.table, own.rows.where(test))

    def _relation(self, table: str, name: str) -> OneToMany | ManyToMany:
        try:
            return self.relations[table][name]
        except KeyError:
            raise ValueError(f"{table} has no relation {name}") from None

    def _satisfying(self, table: str, predicate: Predicate, opposite: bool = False) -> DataFrame:
        """Rows of a table that satisfy a predicate; opposite: those for which it is false."""
        every = self.tables[table]
        if predicate is None:
            return every.limit(0) if opposite else every
        if isinstance(predicate, Column):
            return every.where(~predicate if opposite else predicate)
        if isinstance(predicate, Quantifier) and not (opposite and "." in predicate.path):
            # The opposite of "some row" is "no row", that of "no row fails" is "some row fails": the same keys either way.
            return self._quantified(Row(table, every), predicate.path, predicate.predicate, predicate.every != opposite, predicate.every).rows
        kept = predicate(Row(table, every)) if not isinstance(predicate, Quantifier) else self._satisfying(table, predicate)
        kept = kept.rows if isinstance(kept, Row) else kept
        if not opposite:
            return kept
        # A filter of one's own: the rows that it leaves out, as whole rows, null-safe over all columns.
        marked = kept.distinct()
        test = reduce(lambda a, b: a & b, (F.col(f"__all.{c}").eqNullSafe(F.col(f"__kept.{c}")) for c in every.columns))
        return every.alias("__all").join(marked.alias("__kept"), test, "left_anti")

    def _keys(self, table: str, name: str, predicate: Predicate, opposite: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
        """(keys of the related rows that satisfy a predicate, pairs of parent column and key column)."""
        r = self._relation(table, name)
        if isinstance(r, OneToMany):
            child = self._satisfying(r.child, predicate, opposite)
            return child.select(*[F.col(c).alias(f"__k{i}") for i, (_, c) in enumerate(r.pairs)]), [(p, f"__k{i}") for i, (p, _) in enumerate(r.pairs)]
        target = self._satisfying(r.target, predicate, opposite).select(*[F.col(t).alias(f"__t{i}") for i, (_, t) in enumerate(r.right)])
        junction = self.tables[r.junction].select(*[F.col(j).alias(f"__k{i}") for i, (_, j) in enumerate(r.left)], *[F.col(j).alias(f"__j{i}") for i, (j, _) in enumerate(r.right)])
        met = junction.join(target, reduce(lambda a, b: a & b, (F.col(f"__j{i}") == F.col(f"__t{i}") for i in range(len(r.right)))), "left_semi")
        return met.select(*[f"__k{i}" for i in range(len(r.left))]), [(p, f"__k{i}") for i, (p, _) in enumerate(r.left)]

    def _quantified(self, of: str | Row, path: str, predicate: Predicate, without: bool, opposite: bool) -> Row:
        """Rows with a related row that satisfies the predicate (opposite: that fails it), or those without one."""
        own, how = self.rows(of), "left_anti" if without else "left_semi"
        *hops, last = path.split(".")
        if hops:
            # Hops before the last are inner joins: they filter and multiply the rows, as a join to them would.
            rows, table, prefix = own.rows, own.table, ""
            for hop in hops:
                rows, table, prefix = self._hop(rows, table, hop, prefix, "inner")
            keys, pairs = self._keys(table, last, predicate, opposite)
            test = reduce(lambda a, b: a & b, (rows[prefix + p] == keys[k] for p, k in pairs))
            return Row(own.table, rows.join(keys, test, how).select(*own.rows.columns))
        keys, pairs = self._keys(own.table, last, predicate, opposite)
        return Row(own.table, own.rows.join(keys, reduce(lambda a, b: a & b, (own.rows[p] == keys[k] for p, k in pairs)), how))

    def exists(self, of: str | Row, path: str, predicate: Predicate = None) -> Row:
        """Rows with a related row that satisfies the predicate."""
        return self._quantified(of, path, predicate, False, False)

    def forall(self, of: str | Row, path: str, predicate: Predicate) -> Row:
        """Rows without a related row that fails the predicate; true for rows without any."""
        return self._quantified(of, path, predicate, True, True)

    def marked(self, of: str | Row, path: str, predicate: Predicate, name: str) -> Row:
        """The rows with a boolean column: whether a related row satisfies the predicate. For use under OR and NOT."""
        own = self.rows(of)
        keys, pairs = self._keys(own.table, path, predicate)
        keys = keys.distinct().withColumn(name, F.lit(True))
        joined = own.rows.join(keys, reduce(lambda a, b: a & b, (own.rows[p] == keys[k] for p, k in pairs)), "left")
        return Row(own.table, joined.select(*[own.rows[c] for c in own.rows.columns], F.coalesce(keys[name], F.lit(False)).alias(name)))

    def _hop(self, rows: DataFrame, table: str, name: str, prefix: str, how: str) -> tuple[DataFrame, str, str]:
        """rows joined along one relation; the new columns' names begin with the path so far."""
        r, new = self._relation(table, name), f"{prefix}{name}_"
        target = r.child if isinstance(r, OneToMany) else r.target
        far = self.tables[target]
        far = far.select(*[F.col(c).alias(new + c) for c in far.columns])
        if isinstance(r, OneToMany):
            test = reduce(lambda a, b: a & b, (rows[prefix + p] == far[new + c] for p, c in r.pairs))
            return rows.join(far, test, how), target, new
        junction = self.tables[r.junction].select(*[F.col(j).alias(f"__l{i}") for i, (_, j) in enumerate(r.left)], *[F.col(j).alias(f"__r{i}") for i, (j, _) in enumerate(r.right)])
        rows = rows.join(junction, reduce(lambda a, b: a & b, (rows[prefix + p] == junction[f"__l{i}"] for i, (p, _) in enumerate(r.left))), how)
        rows = rows.join(far, reduce(lambda a, b: a & b, (rows[f"__r{i}"] == far[new + t] for i, (_, t) in enumerate(r.right))), how)
        return rows.drop(*[f"__l{i}" for i in range(len(r.left))], *[f"__r{i}" for i in range(len(r.right))]), target, new

    def along(self, of: str | Row, path: str) -> DataFrame:
        """The rows with the columns of the tables along a path, by outer joins; rows multiply with their related rows.

        A related table's columns are called by the path to it: orders_o_totalprice, orders_lines_l_quantity.
        """
        own = self.rows(of)
        rows, table, prefix = own.rows, own.table, ""
        for hop in path.split("."):
            rows, table, prefix = self._hop(rows, table, hop, prefix, "left")
        return rows
