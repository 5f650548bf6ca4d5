"""Layout changes of the long form: projections over index columns, so Catalyst prunes and pushes through them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.errors import ShapeError
from gneiss.meta import broadcast_shape, infer_shape, normalize_axis, strides
from gneiss.sources.arrays import grid


def _axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def linear(shape: tuple[int, ...]):
    return reduce(lambda a, b: a + b, [F.col(f"i{k}") * s for k, s in enumerate(strides(shape))], F.lit(0)).cast("bigint")


def reshape(df: DataFrame, shape: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    new = infer_shape(new, reduce(lambda a, b: a * b, shape, 1))
    s = strides(new)
    d = df.select(linear(shape).alias("_n"), "v")
    return d.select(*[(F.floor(F.col("_n") / s[k]) % new[k]).cast("bigint").alias(f"i{k}") for k in range(len(new))], "v")


def ravel(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    return df.select(linear(shape).alias("i0"), "v")


def transpose(df: DataFrame, rank: int, axes: tuple[int, ...] | None = None) -> DataFrame:
    axes = tuple(reversed(range(rank))) if axes is None else tuple(normalize_axis(a, rank) for a in axes)
    if sorted(axes) != list(range(rank)):
        raise ShapeError("axes are not a permutation")
    return df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(axes)], "v")


def squeeze(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    keep = [k for k, n in enumerate(shape) if n != 1]
    return df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(keep)], "v")


def expand_dims(df: DataFrame, rank: int, axis: int) -> DataFrame:
    axis = normalize_axis(axis, rank + 1)
    cols = _axes(rank)
    cols = [F.col(c) for c in cols[:axis]] + [F.lit(0).cast("bigint")] + [F.col(c) for c in cols[axis:]]
    return df.select(*[c.alias(f"i{k}") for k, c in enumerate(cols)], "v")


def take_slice(df: DataFrame, axis: int, lo: int, hi: int, step: int = 1) -> DataFrame:
    c = F.col(f"i{axis}")
    return df.filter((c >= lo) & (c < hi) & ((c - lo) % step == 0)).withColumn(f"i{axis}", F.floor((c - lo) / step).cast("bigint"))


def concatenate(parts: list[tuple[DataFrame, tuple[int, ...]]], axis: int = 0) -> DataFrame:
    if not parts:
        raise ShapeError("nothing to concatenate")
    at, out = 0, []
    for df, shape in parts:
        out.append(df.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(at)))
        at += shape[axis]
    return reduce(DataFrame.unionByName, out)


def stack(parts: list[DataFrame], rank: int, axis: int = 0) -> DataFrame:
    out = [expand_dims(p, rank, axis).withColumn(f"i{axis}", F.lit(k).cast("bigint")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, out)


def split(df: DataFrame, n: int, sections: int, axis: int = 0) -> DataFrame:
    """Equal sections, as a part column."""
    if n % sections:
        raise ShapeError("sections do not divide the axis")
    w, c = n // sections, F.col(f"i{axis}")
    return df.withColumn("part", F.floor(c / w).cast("bigint")).withColumn(f"i{axis}", c % w)


def split_at(df: DataFrame, n: int, cuts: list[int], axis: int = 0) -> DataFrame:
    """Sections that begin at 0 and at each cut, as a part column."""
    starts = [0, *sorted(max(0, min(n, c if c >= 0 else c + n)) for c in cuts)]
    c = F.col(f"i{axis}")
    part, base = F.lit(0), F.lit(0)
    for k, lo in enumerate(starts[1:], 1):
        part, base = F.when(c >= lo, k).otherwise(part), F.when(c >= lo, lo).otherwise(base)
    return df.withColumn("part", part.cast("bigint")).withColumn(f"i{axis}", (c - base).cast("bigint"))


def array_split(df: DataFrame, n: int, sections: int, axis: int = 0) -> DataFrame:
    """Sections of nearly equal size: the first n % sections have one more."""
    size, more = divmod(n, sections)
    ends = [k * size + min(k, more) for k in range(1, sections)]
    return split_at(df, n, ends, axis)


def swapaxes(df: DataFrame, rank: int, a: int, b: int) -> DataFrame:
    axes = list(range(rank))
    a, b = normalize_axis(a, rank), normalize_axis(b, rank)
    axes[a], axes[b] = axes[b], axes[a]
    return transpose(df, rank, tuple(axes))


def moveaxis(df: DataFrame, rank: int, source: int, target: int) -> DataFrame:
    axes = [k for k in range(rank) if k != normalize_axis(source, rank)]
    axes.insert(normalize_axis(target, rank), normalize_axis(source, rank))
    return transpose(df, rank, tuple(axes))


def broadcast_to(df: DataFrame, shape: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """Axes of one element, and new leading ones, are repeated to the new shape."""
    if broadcast_shape(shape, new) != tuple(new):
        raise ShapeError(f"shape {shape} does not broadcast to {new}")
    lead = len(new) - len(shape)
    d = df.select(*[F.lit(0).cast("bigint").alias(f"i{k}") for k in range(lead)], *[F.col(f"i{k}").alias(f"i{k + lead}") for k in range(len(shape))], "v")
    for k, n in enumerate(new):
        if k < lead or shape[k - lead] != n:
            d = d.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return d


def flip_all(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """All axes reversed."""
    return reduce(lambda d, k: flip(d, shape[k], k), range(len(shape)), df)


def roll_all(df: DataFrame, shape: tuple[int, ...], shift: int) -> DataFrame:
    """The flattened elements shifted round, in the same shape."""
    flat = roll(ravel(df, shape), reduce(lambda a, b: a * b, shape, 1), shift, 0)
    return reshape(flat, (reduce(lambda a, b: a * b, shape, 1),), shape)


def repeat(df: DataFrame, count: int, axis: int = 0) -> DataFrame:
    return df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(f"i{axis}", F.col(f"i{axis}") * count + F.col("_r")).drop("_r")


def tile(df: DataFrame, n: int, count: int, axis: int = 0) -> DataFrame:
    return df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(f"i{axis}", F.col(f"i{axis}") + F.col("_r") * n).drop("_r")


def flip(df: DataFrame, n: int, axis: int = 0) -> DataFrame:
    return df.withColumn(f"i{axis}", F.lit(n - 1) - F.col(f"i{axis}"))


def roll(df: DataFrame, n: int, shift: int, axis: int = 0) -> DataFrame:
    return df.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + F.lit(shift), F.lit(n)).cast("bigint"))


def pad(df: DataFrame, shape: tuple[int, ...], widths: list[tuple[int, int]], value: float = 0.0) -> DataFrame:
    """Constant padding: only the new cells are generated."""
    new = tuple(n + a + b for n, (a, b) in zip(shape, widths, strict=True))
    moved = df.select(*[(F.col(f"i{k}") + widths[k][0]).cast("bigint").alias(f"i{k}") for k in range(len(shape))], "v")
    inside = reduce(lambda a, b: a & b, [(F.col(f"i{k}") >= w[0]) & (F.col(f"i{k}") < w[0] + n) for k, (n, w) in enumerate(zip(shape, widths, strict=True))])
    return moved.unionByName(grid(df.sparkSession, new).filter(~inside).withColumn("v", F.lit(value)))


def diagonal(df: DataFrame, k: int = 0) -> DataFrame:
    return df.filter(F.col("i1") - F.col("i0") == k).select((F.col("i0") if k >= 0 else F.col("i1")).alias("i0"), "v")


def atleast(df: DataFrame, rank: int, least: int) -> DataFrame:
    """Axes of one element up to least (1 to 3): a vector becomes a row, or the middle axis of three; a matrix gets a last axis."""
    if not 1 <= least <= 3:
        raise ShapeError(f"at least {least} axes")
    while rank < least:
        df = expand_dims(df, rank, 0 if rank < 2 else rank)
        rank += 1
    return df


def copy_where(target: DataFrame, source: DataFrame, source_shape: tuple[int, ...], shape: tuple[int, ...], where: DataFrame | None = None) -> DataFrame:
    """target with source's elements, repeated to its shape, wherever the boolean array where (of the same shape) is true."""
    if broadcast_shape(source_shape, shape) != tuple(shape):
        raise ShapeError(f"shape {source_shape} does not broadcast to {shape}")
    if where is not None and dict(where.dtypes)["v"] != "boolean":
        raise TypeError("the mask has to be boolean")
    both = zip_map(target, shape, source, source_shape, lambda old, new: F.struct(old.alias("old"), new.alias("new")))
    if where is None:
        return both.select(*_axes(len(shape)), F.col("v.new").alias("v"))
    return zip_map(both, shape, where, shape, lambda p, m: F.when(m, p["new"]).otherwise(p["old"]))


def map_cells(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f of each element, as a column expression (or a Pandas UDF applied to it)."""
    return df.withColumn("v", f(F.col("v")))


def map_indexed(df: DataFrame, rank: int, f: Callable[..., Column]) -> DataFrame:
    """f(i0, i1, ..., element) of each element."""
    return df.withColumn("v", f(*[F.col(c) for c in _axes(rank)], F.col("v")))


def zip_map(a: DataFrame, a_shape: tuple[int, ...], b: DataFrame, b_shape: tuple[int, ...], f: Callable[..., Column], indexed: bool = False) -> DataFrame:
    """f(x, y) of two arrays' elements under broadcasting, or f(i0, ..., x, y). An operand that has the result's shape is not
    repeated: the other is joined to it on the axes where that has more than one element."""
    shape = broadcast_shape(a_shape, b_shape)
    if tuple(a_shape) != shape and tuple(b_shape) != shape:
        a, a_shape = broadcast_to(a, a_shape, shape), shape
    whole, part, part_shape = (a, b, b_shape) if tuple(a_shape) == shape else (b, a, a_shape)
    lead = len(shape) - len(part_shape)
    on = [k for k in range(len(shape)) if k >= lead and part_shape[k - lead] == shape[k]]
    other = part.select(*[F.col(f"i{k - lead}").alias(f"i{k}") for k in on], F.col("v").alias("_w"))
    d = whole.join(other, [f"i{k}" for k in on]) if on else whole.crossJoin(F.broadcast(other))  # one element
    x, y = (F.col("v"), F.col("_w")) if whole is a else (F.col("_w"), F.col("v"))
    axes = _axes(len(shape))
    return d.select(*axes, f(*([F.col(c) for c in axes] if indexed else []), x, y).alias("v"))
