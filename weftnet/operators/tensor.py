"""A labelled complex tensor as a relation.

A tensor is a DataFrame with a whole-number column per index label and the values `re` and `im`;
coordinates that aren't there are zero. Labels are metadata: internally the index columns are
x0, x1, ... in label order, so any string may be a label. Every operator is a lazy composition of
DataFrame operations; nothing runs before a value, a scalar or rows are asked for.

Values may be doubles or whole numbers (then sums stay exact). A dimension may be None where it isn't
known (an index that comes from a key of a table); operators that need it raise.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions.labels import difference, intersection, label_name
from weftnet.functions.positions import checked, ravel, ravel_column, unravel, unravel_columns

#: More values than this go to Spark as rows of a local relation; fewer become a VALUES list, whose size Catalyst knows.
INLINE_VALUES = 2048
PRECISIONS = {"double": "double", "float": "float", "complex128": "double", "complex64": "float"}


def _literal(x: float) -> str:
    return f"{float(x)!r}D"


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    labels: tuple[str, ...]
    dims: tuple[int | None, ...]
    summed: bool = True  # whether a coordinate has one row at most

    # Construction.

    def __post_init__(self):
        if len(set(self.labels)) != len(self.labels):
            raise ValueError(f"a label is repeated in {list(self.labels)}")
        if len(self.labels) != len(self.dims):
            raise ValueError(f"{len(self.labels)} labels for {len(self.dims)} dimensions")

    @staticmethod
    def from_entries(spark: SparkSession, labels: Sequence[str], dims: Sequence[int], entries: Iterable[tuple[Sequence[int], complex]], precision: str = "double") -> Tensor:
        """From coordinates and values; zeros are left out."""
        kind = value_type(precision)
        rows = [(*map(int, i), complex(v).real, complex(v).imag) for i, v in entries if v != 0]
        names = [*_names(len(labels)), "re", "im"]
        for row in rows:
            ravel(row[:-2], dims)
        if len(rows) > INLINE_VALUES:
            schema = ", ".join(f"{n} bigint" for n in names[:-2]) + (", " if labels else "") + "re double, im double"
            df = spark.createDataFrame(rows, schema)
        elif rows:
            text = ", ".join("(" + ", ".join([*(f"{i}L" for i in r[:-2]), _literal(r[-2]), _literal(r[-1])]) + ")" for r in rows)
            df = spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")
        else:
            df = spark.range(0).select(*[F.lit(0).cast("long").alias(n) for n in names[:-2]], F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        if kind != "double":
            df = df.select(*names[:-2], F.col("re").cast(kind).alias("re"), F.col("im").cast(kind).alias("im"))
        return Tensor(df, tuple(labels), tuple(dims))

    @staticmethod
    def from_data(spark: SparkSession, labels: Sequence[str], dims: Sequence[int], data: Sequence[complex] | None = None, precision: str = "double") -> Tensor:
        """From values in row-major order; without values all are zero."""
        size = prod(dims)
        data = [0] * size if data is None else list(data)
        if len(data) != size:
            raise ValueError(f"{len(data)} values for {size} places")
        return Tensor.from_entries(spark, labels, dims, ((unravel(k, dims), v) for k, v in enumerate(data)), precision)

    @staticmethod
    def scalar_of(spark: SparkSession, value: complex = 0) -> Tensor:
        return Tensor.from_entries(spark, [], [], [((), value)])

    @staticmethod
    def from_relation(df: DataFrame, labels: dict[str, Column], re: Column, im: Column | None = None, dims: dict[str, int] | None = None, summed: bool = True, unique: bool = False, check: bool = False) -> Tensor:
        """From rows of a table: index columns by label, values summed where coordinates repeat.

        `unique` says that the labels hold a key, so that there is nothing to sum. `summed=False` puts the
        sum off until an operator needs it; a contraction sums anyway. `check` makes the query fail on a
        coordinate outside its dimension.
        """
        im = F.lit(0).cast("long") if im is None else im
        names, dims = _names(len(labels)), dims or {}
        at = [checked(c.cast("long"), dims[x]) if check and dims.get(x) is not None else c.cast("long") for x, c in labels.items()]
        rows = df.select(*[c.alias(n) for n, c in zip(names, at, strict=True)], re.alias("re"), im.alias("im"))
        whole = summed and not unique
        return Tensor(_summed(rows, names) if whole else rows, tuple(labels), tuple(dims.get(label) for label in labels), whole or unique)

    @staticmethod
    def random(spark: SparkSession, labels: Sequence[str], dims: Sequence[int], seed: int | None = None) -> Tensor:
        """Parts uniform on [-1, 1) from hashes of position and seed: equal seeds give equal tensors, however rows are dealt."""
        rows = spark.range(prod(dims))
        seed = secrets.randbits(62) if seed is None else seed
        draw = lambda k: F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(k), "id"), F.lit(1 << 53)) / float(1 << 53)
        return Tensor(rows.select(*_at(F.col("id"), dims), (draw(0) * 2 - 1).alias("re"), (draw(1) * 2 - 1).alias("im")), tuple(labels), tuple(dims))

    # Metadata.

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def names(self) -> list[str]:
        return _names(len(self.labels))

    @property
    def rank(self) -> int:
        return len(self.labels)

    @property
    def size(self) -> int:
        return prod(self._known_dims())

    @property
    def is_scalar(self) -> bool:
        return self.size == 1

    def dim(self, label: str) -> int | None:
        return self.dims[self._place(label)]

    def column(self, label: str) -> Column:
        return F.col(self.names[self._place(label)])

    def _place(self, label: str) -> int:
        if label not in self.labels:
            raise ValueError(f"the tensor has no label {label!r}, only {list(self.labels)}")
        return self.labels.index(label)

    def _known_dims(self) -> tuple[int, ...]:
        if any(d is None for d in self.dims):
            raise ValueError(f"a dimension of {list(self.labels)} isn't known")
        return self.dims  # type: ignore[return-value]

    def whole(self) -> Tensor:
        """This tensor with a row a coordinate at most."""
        return self if self.summed else Tensor(_summed(self.df, self.names), self.labels, self.dims)

    # Operators.

    def contract(self, other: Tensor, keep: Sequence[str] = ()) -> Tensor:
        """Sums over all shared labels but those in `keep`; labels of self first, then of other.

        Without a shared label this is the outer product. A kept label is not summed and stays with
        self's labels: it stands for slices that are contracted side by side.
        """
        shared = intersection(self.labels, other.labels)
        for label in shared:
            a, b = self.dim(label), other.dim(label)
            if a is not None and b is not None and a != b:
                raise ValueError(f"the label {label!r} has {a} values here and {b} there")
        left = [label for label in self.labels if label not in shared or label in keep]
        right = difference(other.labels, self.labels)
        a = self.df.select(*[F.col(n).alias(f"a{n}") for n in self.names], F.col("re").alias("are"), F.col("im").alias("aim"))
        b = other.df.select(*[F.col(n).alias(f"b{n}") for n in other.names], F.col("re").alias("bre"), F.col("im").alias("bim"))
        mine = lambda label: F.col(f"a{self.names[self._place(label)]}")
        yours = lambda label: F.col(f"b{other.names[other._place(label)]}")
        if shared:
            rows = a.join(b, reduce(lambda x, y: x & y, [mine(label) == yours(label) for label in shared]))
        else:
            rows = a.crossJoin(b)
        names = _names(len(left) + len(right))
        rows = rows.select(
            *[c.alias(n) for n, c in zip(names, [*map(mine, left), *map(yours, right)], strict=True)],
            (F.col("are") * F.col("bre") - F.col("aim") * F.col("bim")).alias("re"), (F.col("are") * F.col("bim") + F.col("aim") * F.col("bre")).alias("im"),
        )
        summed = [label for label in shared if label not in keep]
        dims = [self.dim(x) if self.dim(x) is not None or x not in other.labels else other.dim(x) for x in left] + [other.dim(x) for x in right]
        return Tensor(_summed(rows, names) if summed else rows, (*left, *right), tuple(dims), bool(summed) or (self.summed and other.summed))

    def sum_out(self, labels: Sequence[str]) -> Tensor:
        """Adds the slices along labels."""
        stay = difference(self.labels, labels)
        rows = self.df.select(*[self.column(x).alias(n) for n, x in zip(_names(len(stay)), stay, strict=True)], "re", "im")
        return Tensor(_summed(rows, _names(len(stay))), tuple(stay), tuple(self.dim(x) for x in stay))

    def add(self, other: Tensor) -> Tensor:
        """Element-wise sum, in self's label order."""
        return add_all([self, other])

    def slice(self, label: str, value: int) -> Tensor:
        """Fixes one label at a value."""
        d = self.dim(label)
        if d is not None and not 0 <= value < d:
            raise ValueError(f"{value} is outside the {d} values of {label!r}")
        stay = difference(self.labels, [label])
        rows = self.df.where(self.column(label) == value).select(*[self.column(x).alias(n) for n, x in zip(_names(len(stay)), stay, strict=True)], "re", "im")
        return Tensor(rows, tuple(stay), tuple(self.dim(x) for x in stay), self.summed)

    def transpose(self, order: Sequence[str] | Sequence[int]) -> Tensor:
        """Another order of labels, given by name or by position; no data moves."""
        order = list(order)
        if order and all(isinstance(x, int) for x in order):
            if sorted(order) != list(range(self.rank)):  # type: ignore[type-var]
                raise ValueError(f"{order} is not an order of {self.rank} positions")
            order = [self.labels[x] for x in order]  # type: ignore[index]
        if sorted(order) != sorted(self.labels):  # type: ignore[type-var]
            raise ValueError(f"{order} is not an order of {list(self.labels)}")
        rows = self.df.select(*[self.column(x).alias(n) for n, x in zip(self.names, order, strict=True)], "re", "im")  # type: ignore[arg-type]
        return Tensor(rows, tuple(order), tuple(self.dim(x) for x in order), self.summed)  # type: ignore[arg-type]

    def reshape(self, dims: Sequence[int], batch: Sequence[str] = ()) -> Tensor:
        """The same row-major data in another shape, with generated labels ?a, ?b, ...

        Labels in `batch` come first and stay: each of their slices is reshaped.
        """
        rest = difference(self.labels, batch)
        old = [self.dim(x) for x in rest]
        if any(d is None for d in old) or prod(dims) != prod(old):  # type: ignore[arg-type]
            raise ValueError(f"the shape {old} can't become {list(dims)}")
        at = ravel_column([self.column(x) for x in rest], old)  # type: ignore[arg-type]
        columns = [*[self.column(x) for x in batch], *unravel_columns(at, dims)]
        rows = self.df.select(*[c.alias(n) for n, c in zip(_names(len(columns)), columns, strict=True)], "re", "im")
        return Tensor(rows, (*batch, *("?" + label_name(k) for k in range(len(dims)))), (*(self.dim(x) for x in batch), *dims), self.summed)

    def position(self) -> Column:
        """Row-major position of a row."""
        return ravel_column([F.col(n) for n in self.names], self._known_dims())

    def conj(self) -> Tensor:
        return Tensor(self.df.withColumn("im", -F.col("im")), self.labels, self.dims, self.summed)

    def scale(self, value: complex) -> Tensor:
        value = complex(value)
        re, im = F.lit(value.real), F.lit(value.imag)
        rows = self.df.select(*self.names, (F.col("re") * re - F.col("im") * im).alias("re"), (F.col("re") * im + F.col("im") * re).alias("im"))
        return Tensor(rows, self.labels, self.dims, self.summed)

    def rename(self, which: str | int, label: str) -> Tensor:
        """Another label at a place; a label that is there already is refused."""
        k = which if isinstance(which, int) else self._place(which)
        if not 0 <= k < self.rank:
            raise ValueError(f"no label at place {k}")
        return Tensor(self.df, tuple(label if j == k else x for j, x in enumerate(self.labels)), self.dims, self.summed)

    def relabel(self, labels: Sequence[str]) -> Tensor:
        return Tensor(self.df, tuple(labels), self.dims, self.summed)

    def set_value(self, index: Sequence[int], value: complex) -> Tensor:
        """A tensor with another value at one place."""
        ravel(index, self._known_dims())
        rest = self.df.where(~self._here(index))
        kinds = dict(self.df.dtypes)
        one = self.spark.range(1).select(*[F.lit(int(i)).cast("long").alias(n) for n, i in zip(self.names, index, strict=True)], F.lit(complex(value).real).cast(kinds["re"]).alias("re"), F.lit(complex(value).imag).cast(kinds["im"]).alias("im"))
        return Tensor(rest.unionByName(one), self.labels, self.dims, self.summed)

    def densify(self) -> Tensor:
        """All coordinates, zeros included."""
        dims = self._known_dims()
        every = self.spark.range(prod(dims)).select(*_at(F.col("id"), dims))
        kinds = dict(self.df.dtypes)
        df = self.whole().df
        rows = every.join(df, self.names, "left") if self.rank else every.crossJoin(df)
        return Tensor(rows.select(*self.names, *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in ("re", "im")]), self.labels, self.dims)

    def differences(self, other: Tensor, tolerance: float = 0.0) -> DataFrame:
        """One row: the number of places whose values differ by more than the tolerance."""
        mine, other = self.whole().df, other.transpose(self.labels).whole()
        b = other.df.select(*self.names, F.col("re").alias("bre"), F.col("im").alias("bim"))
        rows = mine.join(b, self.names, "full") if self.rank else mine.crossJoin(b)
        gap = lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))) > tolerance
        return rows.agg(F.count_if(gap(F.col("re"), F.col("bre")) | gap(F.col("im"), F.col("bim"))).alias("differences"))

    def equals(self, other: Tensor, tolerance: float = 0.0) -> bool:
        """Same ordered labels, shape and values."""
        return self.labels == other.labels and self.dims == other.dims and self.differences(other, tolerance).first()[0] == 0

    # Asking for values.

    def _here(self, index: Sequence[int]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(n) == int(i) for n, i in zip(self.names, index, strict=True)], F.lit(True))

    def value(self, index: Sequence[int] = ()) -> complex:
        ravel(index, self._known_dims())
        row = self.df.where(self._here(index)).agg(F.sum("re"), F.sum("im")).first()
        return complex(row[0] or 0, row[1] or 0)

    def value_at(self, position: int) -> complex:
        return self.value(unravel(position, self._known_dims()))

    def scalar(self) -> complex:
        """The value at position 0."""
        return self.value_at(0)

    def data(self) -> list[complex]:
        """All values in row-major order, on the driver."""
        out = [0j] * self.size
        for k, re, im in self.df.select(self.position(), "re", "im").collect():
            out[k] += complex(re, im)
        return out

    def shown(self, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows with a column per label (or other names for them)."""
        columns = list(columns or self.labels)
        return self.whole().df.select(*[F.col(n).alias(c) for n, c in zip(self.names, columns, strict=True)], "re", "im")

    def describe(self) -> str:
        """Size, labels and data as text."""
        values = " ".join(f"({v.real:g},{v.imag:g})" for v in self.data())
        return f"Size={self.size}\nIndices={{{' '.join(self.labels)}}}\nData={{{values}}}"


def as_precision(t: Tensor, precision: str) -> Tensor:
    """The tensor with values of a precision."""
    kind = value_type(precision)
    return Tensor(t.df.select(*t.names, F.col("re").cast(kind).alias("re"), F.col("im").cast(kind).alias("im")), t.labels, t.dims, t.summed)


def value_type(precision: str) -> str:
    if precision not in PRECISIONS:
        raise TypeError(f"values of type {precision!r} are not supported")
    return PRECISIONS[precision]


def add_all(tensors: Sequence[Tensor]) -> Tensor:
    """Element-wise sum of tensors with the same labels, in the first one's order."""
    first = tensors[0]
    for t in tensors[1:]:
        if sorted(t.labels) != sorted(first.labels) or {x: t.dim(x) for x in t.labels} != {x: first.dim(x) for x in first.labels}:
            raise ValueError(f"can't add {list(t.labels)} to {list(first.labels)}")
    rows = reduce(lambda x, y: x.unionByName(y), [t.transpose(first.labels).df for t in tensors])
    return Tensor(_summed(rows, first.names), first.labels, first.dims)


def _names(n: int) -> list[str]:
    return [f"x{k}" for k in range(n)]


def _at(position: Column, dims: Sequence[int]) -> list[Column]:
    return [c.alias(n) for n, c in zip(_names(len(dims)), unravel_columns(position, dims), strict=True)]


def _summed(rows: DataFrame, names: list[str]) -> DataFrame:
    if names:
        return rows.groupBy(*names).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    kinds = {n: "bigint" if k in ("bigint", "int") else "double" for n, k in rows.dtypes}
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0).cast(kinds[c])).alias(c) for c in ("re", "im")])
