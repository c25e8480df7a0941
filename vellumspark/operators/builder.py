"""A chainable query over one table (P-1..P-17, S-1, S-2). Conditions are Columns from the start; OR conditions may come as a text too."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_ci

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "like", "ilike", "is", "in", "contains")


def condition(column: str, op: str, value) -> Column:
    """P-2..P-8, P-10, P-21, P-23: one predicate. neq drops nulls; an empty list is in nothing; like and ilike ignore ASCII case; contains is of arrays, or of text."""
    c = F.col(column)
    if op == "eq":
        return c == F.lit(value)
    if op == "neq":
        return c != F.lit(value)
    if op in ("gt", "gte", "lt", "lte"):
        v = F.lit(value)
        return {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    if op == "in":
        return c.isin(list(value)) if list(value) else F.lit(False)
    if op == "is":
        return c.isNull() if value is None else c == F.lit(value)
    if op in ("like", "ilike"):
        return like_ci(c, value)
    if op == "contains":
        if isinstance(value, (list, tuple)):
            return reduce(lambda a, b: a & b, [F.array_contains(c, x) for x in value], F.lit(True))
        return F.contains(c, F.lit(value))
    raise ValueError(f"unknown operator {op!r}")


def parse_or(text: str) -> list[Column]:
    """P-11: the conditions of an OR text: ``a.eq.1,b.in.(x,y),c.not.is.null``. Commas inside parentheses part nothing; values are texts, as they stand; a clause that isn't column, operator and value raises."""
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    out = []
    for part in [p for p in (*parts, now) if p]:
        column, *rest = part.split(".", 1)
        op, *value = rest[0].split(".", 1) if rest else [""]
        negate = op == "not" and value
        if negate:
            op, *value = value[0].split(".", 1)
        if not column or not value or not value[0] or op not in OPS:
            raise ValueError(f"no condition: {part!r}")
        v = value[0]
        if op == "in":
            v = v.removeprefix("(").removesuffix(")")
            v = v.split(",") if v else []
        elif op == "is" and v == "null":
            v = None
        got = condition(column, op, v)
        out.append(~got if negate else got)
    return out


class NoRow(ValueError):
    """single() found none."""


class ManyRows(ValueError):
    """single() found more than one."""


@dataclass(frozen=True)
class Query:
    """Immutable: each call returns a new one. P-1, P-9, P-11..P-14, S-1, S-2. Nothing runs before frame()'s result is used or single(), maybe_single() or count() is called."""

    source: DataFrame
    columns: tuple[str, ...] = ("*",)
    where: tuple[Column, ...] = ()
    orders: tuple[Column, ...] = ()
    skip: int = 0
    most: int | None = None

    def _with(self, **k) -> Query:
        return Query(**{**self.__dict__, **k})

    def select(self, *columns: str) -> Query:
        return self._with(columns=columns or ("*",))

    def filter(self, column: str, op: str, value) -> Query:
        return self._with(where=(*self.where, condition(column, op, value)))

    def match(self, **values) -> Query:
        return reduce(lambda q, kv: q.filter(kv[0], "eq", kv[1]), values.items(), self)

    def not_(self, column: str, op: str, value) -> Query:
        return self._with(where=(*self.where, ~condition(column, op, value)))

    def any_of(self, *conditions: tuple[str, str, object]) -> Query:
        """OR of conditions."""
        return self._with(where=(*self.where, reduce(lambda a, b: a | b, [condition(*c) for c in conditions], F.lit(False))))

    def or_text(self, text: str) -> Query:
        """P-11: OR of the conditions of a text; an empty text has none and keeps all rows."""
        found = parse_or(text)
        return self._with(where=(*self.where, reduce(lambda a, b: a | b, found))) if found else self

    def if_given(self, column: str, value) -> Query:
        """P-17: no condition where the value is None."""
        return self if value is None else self.filter(column, "eq", value)

    def order(self, column: str, ascending: bool = True) -> Query:
        """Nulls are least in both directions' sense: first ascending, last descending."""
        c = F.col(column)
        return self._with(orders=(*self.orders, c.asc_nulls_first() if ascending else c.desc_nulls_last()))

    def limit(self, n: int) -> Query:
        return self._with(most=n)

    def range(self, start: int, end: int) -> Query:
        """Rows start to end, both included, from 0."""
        return self._with(skip=start, most=end - start + 1)

    def _filtered(self) -> DataFrame:
        return self.source.where(reduce(lambda a, b: a & b, self.where)) if self.where else self.source

    def frame(self) -> DataFrame:
        df = self._filtered()
        if self.orders:
            df = df.orderBy(*self.orders)
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*self.columns)

    def count_frame(self) -> DataFrame:
        """P-15 as a frame of one row (n): all matching rows, whatever the limit."""
        return self._filtered().agg(F.count("*").alias("n"))

    def count(self) -> int:
        """P-15: all matching rows, whatever the limit."""
        return self.count_frame().first().n

    def single(self):
        rows = self.frame().take(2)
        if not rows:
            raise NoRow("no row")
        if len(rows) > 1:
            raise ManyRows("more than one row")
        return rows[0]

    def maybe_single(self):
        rows = self.frame().take(2)
        if len(rows) > 1:
            raise ManyRows("more than one row")
        return rows[0] if rows else None


def from_table(source: DataFrame) -> Query:
    """SRC-1."""
    return Query(source)
