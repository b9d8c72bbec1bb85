"""Values of a panel and the layers of windows that they need.

Spark has no window function inside another's argument. A ``Value`` knows whether its
column holds a window; an operator that needs a window over it has it laid down first, as a
named column of an earlier ``select``. All columns of one depth are laid down together, so that
windows of the same partitioning share one exchange and one sort. Equal sub-expressions are
one value (``Panel.memo``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class Value:
    column: Column
    window: bool = False  # the column holds a window function
    depth: int = 0  # of the layer that it can be computed in


@dataclass
class Panel:
    """A dense panel: one row for each ``code`` and each row index ``t`` (0, 1, ...), and its fields."""

    frame: DataFrame
    keys: tuple[str, ...] = ("code", "t")
    layers: dict[int, list[Column]] = field(default_factory=dict)
    kernels: dict[int, list[tuple[str, Callable, list[Column], str]]] = field(default_factory=dict)
    memo: dict[object, Value] = field(default_factory=dict)

    def field(self, name: str) -> Value:
        if name not in self.frame.columns:
            raise KeyError(f"the panel has no field {name!r}; it has {', '.join(self.frame.columns)}")
        return Value(F.col(name))

    def each(self, make: Callable[..., Column], *values: Value) -> Value:
        """A value computed row by row from others."""
        return Value(make(*(v.column for v in values)), any(v.window for v in values), max([0, *(v.depth for v in values)]))

    def flat(self, value: Value) -> Value:
        """The value as a plain column, laid down in a layer if it holds a window."""
        if not value.window:
            return value
        key = ("flat", id(value))
        if key not in self.memo:
            name = f"_v{len(self.memo)}"
            self.layers.setdefault(value.depth, []).append(value.column.alias(name))
            self.memo[key] = Value(F.col(name), False, value.depth + 1)
            self.memo[("kept", id(value))] = value  # its id must stay taken
        return self.memo[key]

    def over(self, make: Callable[..., Column], *values: Value) -> Value:
        """A value that make() computes with windows from the columns of others."""
        plain = [self.flat(v) for v in values]
        return Value(make(*(v.column for v in plain)), True, max([0, *(v.depth for v in plain)]))

    def last(self, d: int) -> WindowSpec:
        """The row and the d - 1 before it, of the same code."""
        return Window.partitionBy("code").orderBy("t").rowsBetween(-(d - 1), 0)

    @property
    def history(self) -> WindowSpec:
        return Window.partitionBy("code").orderBy("t")

    @property
    def across(self) -> WindowSpec:
        return Window.partitionBy("t")

    def full(self, d: int, x: Column) -> Column:
        """NULL in the first d - 1 rows."""
        return F.when(F.col("t") >= d - 1, x)

    def array(self, d: int, *values: Value) -> tuple[Value, ...]:
        """For each value the array of its last d elements, missing ones included, laid down together."""
        plain = [self.flat(v) for v in values]
        depth = max(v.depth for v in plain)
        key = ("array", d, depth, *(str(v.column) for v in plain))
        if key not in self.memo:
            name = f"_a{len(self.memo)}"
            rows = F.collect_list(F.struct(*(v.column.cast("double").alias(f"c{i}") for i, v in enumerate(plain)))).over(self.last(d))
            self.layers.setdefault(depth, []).append(rows.alias(name))
            self.memo[key] = Value(F.col(name), False, depth + 1)
        rows = self.memo[key]
        out = []
        for i in range(len(plain)):  # each array is a column of its own: array functions use it often
            inner = ("element", key, i)
            if inner not in self.memo:
                name = f"_e{len(self.memo)}"
                self.layers.setdefault(rows.depth, []).append(rows.column.getField(f"c{i}").alias(name))
                self.memo[inner] = Value(F.col(name), False, rows.depth + 1)
            out.append(self.memo[inner])
        return tuple(out)

    def laid(self) -> DataFrame:
        """The frame with all layers so far; the kernels of one depth and grouping run in one pass."""
        frame = self.frame
        for depth in sorted({*self.layers, *self.kernels}):
            if own := [k for k in self.kernels.get(depth, []) if k[3] == "window"]:
                frame = _slid(frame, own)
            for by in ("code", "t"):  # first: all columns go through Python, and the arrays of the layer need not
                if own := [k for k in self.kernels.get(depth, []) if k[3] == by]:
                    frame = _computed(frame, own, by)
            if depth in self.layers:
                frame = frame.select("*", *self.layers[depth])
        return frame

    def settle(self, frame: DataFrame) -> None:
        """``frame``, which has all columns laid down so far, is where further layers start."""
        self.frame, self.layers, self.kernels = frame, {}, {}

    def whole(self, make: Callable[..., Column], *values: Value, by_row: bool = False) -> Value:
        """One number for the whole panel in every cell: an aggregate of one row, broadcast.

        With ``by_row`` the values are the same for all codes of a row index and count once each.
        """
        plain = [self.flat(v) for v in values]
        frame = self.laid().select("t", *(v.column.alias(f"_w{i}") for i, v in enumerate(plain)))
        if by_row:
            frame = frame.groupBy("t").agg(*(F.first(f"_w{i}").alias(f"_w{i}") for i in range(len(plain))))
        name = f"_one{len(self.memo)}"
        self.memo[("whole", name)] = Value(F.col(name))
        self.frame = self.frame.crossJoin(F.broadcast(frame.agg(make(*(F.col(f"_w{i}") for i in range(len(plain)))).alias(name))))
        return Value(F.col(name))

    def kernel(self, compute: Callable, *values: Value, by: str = "code") -> Value:
        """A value that a Python kernel computes from arrays of doubles (NaN: missing), one group at a time.

        Groups are the histories of a code in order of ``t``, or the codes of a row index in order of code.
        """
        plain = [self.flat(v) for v in values]
        depth = max(v.depth for v in plain)
        name = f"_g{len(self.memo)}"
        self.memo[("kernel", name)] = Value(F.col(name))
        self.kernels.setdefault(depth, []).append((name, compute, [v.column for v in plain], by))
        return Value(F.col(name), False, depth + 1)

    def slide(self, compute: Callable, d: int, *values: Value) -> Value:
        """A value that a Python kernel computes from the last d rows, for many codes at once; missing in the first d - 1 rows of a code.

        ``compute`` gets arrays of doubles with d rows (NaN: missing) and a column for each window, and returns a number for each.
        """
        found = self.kernel(compute, *values)
        name, _, columns, _ = self.kernels[found.depth - 1].pop()
        self.kernels[found.depth - 1].append((name, (compute, d), columns, "window"))
        return found

    def select(self, values: dict[str, Value], *more: str) -> DataFrame:
        """The keys, further columns by name, and the values."""
        return self.laid().select(*self.keys, *more, *(v.column.alias(name) for name, v in values.items()))


def _computed(frame: DataFrame, kernels: list[tuple[str, Callable, list[Column], str]], by: str) -> DataFrame:
    """``frame`` with a column for each kernel, one task per group and one shuffle for all."""
    order, n = ("t" if by == "code" else "code"), len(frame.columns)
    inputs = {str(c): c for _, _, columns, _ in kernels for c in columns}
    place = {k: n + i for i, k in enumerate(inputs)}
    wide = frame.select("*", *(c.cast("double").alias(f"_k{i}") for i, c in enumerate(inputs.values())))
    wanted = [(name, compute, [place[str(c)] for c in columns]) for name, compute, columns, _ in kernels]
    schema = StructType([*frame.schema.fields, *(StructField(name, DoubleType()) for name, _, _ in wanted)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        out = table.select(list(range(n)))
        for name, compute, at in wanted:
            found = np.asarray(compute(*(table.column(i).to_numpy().astype(float) for i in at)), float)
            out = out.append_column(name, pa.array(found, pa.float64(), mask=~np.isfinite(found)))
        return out

    return wide.groupBy(by).applyInArrow(run, schema)


#: Rows of whole groups that are computed together, at least.
TOGETHER = 1 << 13


def ends(*keys: str, by: str = "t") -> Column:
    """Whether a row is the last of its group; the window also brings groups together and sorts them."""
    own = Window.partitionBy(*keys).orderBy(by)
    return F.row_number().over(own) == F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def whole_groups(batches: Iterator[pa.RecordBatch], end: str, together: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``together`` rows or one larger group; the column ``end`` marks last rows."""
    held, n, whole = [], 0, 0
    for batch in batches:
        last = np.nonzero(batch.column(end).to_numpy(zero_copy_only=False))[0]
        whole = n + int(last[-1]) + 1 if len(last) else whole
        held, n = [*held, batch], n + batch.num_rows
        if whole >= together:
            table = pa.Table.from_batches(held)
            yield table.slice(0, whole).combine_chunks()
            held, n, whole = table.slice(whole).combine_chunks().to_batches(), n - whole, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _slid(frame: DataFrame, kernels: list[tuple[str, tuple, list[Column], str]]) -> DataFrame:
    """``frame`` with a column for each kernel over windows: sorted codes, many to a call."""
    n = len(frame.columns)
    inputs = {str(c): c for _, _, columns, _ in kernels for c in columns}
    place = {k: n + i for i, k in enumerate(inputs)}
    wide = frame.select("*", *(c.cast("double").alias(f"_k{i}") for i, c in enumerate(inputs.values())), ends("code").alias("_end"))
    wanted = [(name, compute, d, [place[str(c)] for c in columns]) for name, (compute, d), columns, _ in kernels]
    schema = StructType([*frame.schema.fields, *(StructField(name, DoubleType()) for name, _, _, _ in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_end", TOGETHER):
            rows, made = table.num_rows, {}
            last = np.nonzero(table.column("_end").to_numpy())[0]
            first = np.concatenate(([0], last[:-1] + 1))
            at = np.arange(rows) - np.repeat(first, last - first + 1)  # in its code

            def window(i: int, d: int) -> np.ndarray:
                if (i, d) not in made:
                    x = table.column(i).to_numpy().astype(float)
                    x = np.where(np.isfinite(x), x, np.nan)
                    made[i, d] = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, d).T)
                return made[i, d]

            out = table.select(list(range(n)))
            for name, compute, d, columns in wanted:
                found = np.full(rows, np.nan)
                if rows >= d:
                    with np.errstate(all="ignore"):
                        found[d - 1 :] = compute(*(window(i, d) for i in columns))
                out = out.append_column(name, pa.array(found, pa.float64(), mask=~np.isfinite(found) | (at < d - 1)))
            yield from out.combine_chunks().to_batches()

    return wide.mapInArrow(run, schema)
