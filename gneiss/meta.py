"""Shapes, axes, broadcasting and the dtype lattice: pure Python, no Spark."""

from __future__ import annotations

import math

from gneiss.errors import AxisError, ShapeError

INTS = {"int8": (8, True), "int16": (16, True), "int32": (32, True), "int64": (64, True), "uint8": (8, False), "uint16": (16, False), "uint32": (32, False), "uint64": (64, False)}
SPARK = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}


def promote(a: str, b: str) -> str:
    """The type that holds both: int8 and uint8 give int16, int64 and uint64 give float64, int32 and float32 give float64."""
    if a == b or b == "bool":
        return a
    if a == "bool":
        return b
    if a not in INTS and b not in INTS:
        return "float64"
    if a not in INTS or b not in INTS:
        f, i = (a, b) if a not in INTS else (b, a)
        return f if f == "float64" or INTS[i][0] <= 16 else "float64"
    (x, sx), (y, sy) = INTS[a], INTS[b]
    if sx == sy:
        return a if x >= y else b
    signed, unsigned = (x, y) if sx else (y, x)
    bits = signed if signed > unsigned else 2 * unsigned
    return f"int{bits}" if bits <= 64 else "float64"


def can_cast(a: str, b: str) -> bool:
    """Whether every value of a is exact in b."""
    return promote(a, b) == b


def normalize_axis(axis: int, rank: int) -> int:
    if not -rank <= axis < rank:
        raise AxisError(f"axis {axis} is out of bounds for rank {rank}")
    return axis % rank


def element_count(shape: tuple[int, ...]) -> int:
    return math.prod(shape)


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(math.prod(shape[k + 1 :]) for k in range(len(shape)))


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    n = max(len(a), len(b))
    pairs = zip((1,) * (n - len(a)) + tuple(a), (1,) * (n - len(b)) + tuple(b), strict=True)
    out = []
    for x, y in pairs:
        if x != y and 1 not in (x, y):
            raise ShapeError(f"shapes {a} and {b} do not broadcast")
        out.append(max(x, y) if 0 not in (x, y) else 0)
    return tuple(out)


def infer_shape(shape: tuple[int, ...], size: int) -> tuple[int, ...]:
    """Fills in one -1 and checks the element count."""
    if shape.count(-1) > 1:
        raise ShapeError("at most one dimension can be inferred")
    known = math.prod(d for d in shape if d >= 0)
    if -1 in shape:
        if known == 0 or size % known:
            raise ShapeError(f"cannot reshape {size} elements into {shape}")
        shape = tuple(size // known if d < 0 else d for d in shape)
    if math.prod(shape) != size:
        raise ShapeError(f"cannot reshape {size} elements into {shape}")
    return shape


def slice_bounds(start: int | None, stop: int | None, step: int, n: int) -> tuple[int, int, int]:
    """Clamped bounds; the step must be positive."""
    if step <= 0:
        raise ShapeError("slice step must be positive")
    lo, hi, _ = slice(start, stop, step).indices(n)
    return lo, max(lo, hi), step
