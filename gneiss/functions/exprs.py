"""Column expressions with the array semantics: wrapping integers, IEEE floats, NaN that propagates. JVM-side throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
# Mathematical constants.
CONSTANTS = {
    "E": math.e, "PI": math.pi, "TAU": math.tau, "EULER_GAMMA": 0.5772156649015329, "SQRT_2": math.sqrt(2), "FRAC_1_SQRT_2": math.sqrt(0.5),
    "LN_2": math.log(2), "LN_10": math.log(10), "LOG2_E": math.log2(math.e), "LOG10_E": math.log10(math.e), "FRAC_PI_2": math.pi / 2,
    "FRAC_PI_3": math.pi / 3, "FRAC_PI_4": math.pi / 4, "FRAC_PI_6": math.pi / 6, "FRAC_PI_8": math.pi / 8, "FRAC_1_PI": 1 / math.pi,
    "FRAC_2_PI": 2 / math.pi, "FRAC_2_SQRT_PI": 2 / math.sqrt(math.pi), "LOG2_10": math.log2(10), "LOG10_2": math.log10(2), "PHI": (1 + math.sqrt(5)) / 2,
}
_TYPES = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}


def wrap(c: Column, bits: int) -> Column:
    """An exact integer (bigint, or decimal for 64 bits) reduced to a signed integer of so many bits."""
    half = 1 << (bits - 1)
    if bits == 64:
        d = c.cast("decimal(38,0)")
        big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
        return (F.pmod(d + big(half), big(1 << 64)) - big(half)).cast("bigint")
    return ((c.cast("bigint") + half).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) - half).cast(_TYPES[bits])


def wrap_unsigned(c: Column, bits: int) -> Column:
    """An exact integer reduced modulo 2^bits; 64 bits give decimal(20,0)."""
    if bits == 64:
        return F.pmod(c.cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    return c.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast(_TYPES[2 * bits])


def unsigned(op: str, a: Column, b: Column, bits: int) -> Column:
    """+, - or * of unsigned integers (kept in the next wider type), with wrap."""
    x, y = (c.cast("decimal(20,0)" if bits >= 32 else "bigint") for c in (a, b))
    return wrap_unsigned({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), bits)


def truth(c: Column) -> Column:
    """Whether a number is not zero; NaN is true."""
    return F.isnan(c) | (c != 0)


def logical_xor(a: Column, b: Column) -> Column:
    return truth(a) != truth(b)


def product(x: Column) -> Column:
    """The product of a group as a double; 1 of an empty one."""
    return F.coalesce(F.product(x.cast("double")), F.lit(1.0))


def _exact(c: Column, bits: int) -> Column:
    return c.cast("decimal(38,0)") if bits == 64 else c.cast("bigint")


def add(a: Column, b: Column, bits: int) -> Column:
    return wrap(_exact(a, bits) + _exact(b, bits), bits)


def subtract(a: Column, b: Column, bits: int) -> Column:
    return wrap(_exact(a, bits) - _exact(b, bits), bits)


def multiply(a: Column, b: Column, bits: int) -> Column:
    return wrap(_exact(a, bits) * _exact(b, bits), bits)


def int_divide(a: Column, b: Column, bits: int) -> Column:
    """Truncating; a zero divisor fails the query, MIN / -1 wraps."""
    q = F.when(b == 0, F.raise_error(F.lit("division by zero"))).when(b == -1, negate(a, bits).cast("bigint"))
    return q.otherwise(F.call_function("div", a.cast("bigint"), F.when((b == 0) | (b == -1), F.lit(1)).otherwise(b).cast("bigint"))).cast(_TYPES[bits])


def negate(a: Column, bits: int) -> Column:
    return wrap(-_exact(a, bits), bits)


def absolute(a: Column, bits: int) -> Column:
    return wrap(F.abs(_exact(a, bits)), bits)


def divide(a: Column, b: Column) -> Column:
    """IEEE: x/0 is infinite or NaN by the signs."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF), F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison of floats: every ordering with NaN is false, != is true."""
    nan = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return nan | (a != b)
    return ~nan & {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def pair_min(a: Column, b: Column) -> Column:
    """The smaller; a NaN operand is ignored."""
    return F.least(a, b)


def pair_max(a: Column, b: Column) -> Column:
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a))


def sign(x: Column) -> Column:
    """-1 or 1 by the sign bit, of zeros too; NaN stays."""
    return F.when(F.isnan(x), x).when((x > 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) > 0)), F.lit(1.0)).otherwise(F.lit(-1.0))


def round_half_away(x: Column, decimals: int = 0) -> Column:
    s = 10.0 ** max(-308, min(308, decimals))
    scaled = F.abs(x * s)
    down = F.floor(scaled).cast("double")
    r = F.when(scaled >= 2.0**52, scaled).otherwise(down + F.when(scaled - down >= 0.5, 1.0).otherwise(0.0))
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(F.when(x < 0, -r).otherwise(r) / s)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if any(v is not None and math.isnan(v) for v in (low, high)):
        raise ValueError("clip bounds must not be NaN")
    if low is not None and high is not None and low > high:
        raise ValueError("clip: the minimum exceeds the maximum")
    out = F.when(F.isnan(x), x)
    out = out.when(x < low, F.lit(low)) if low is not None else out
    out = out.when(x > high, F.lit(high)) if high is not None else out
    return out.otherwise(x)


def is_inf(x: Column) -> Column:
    return F.abs(x) == INF


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & ~is_inf(x)


def choose(index: Column, choices: list[Column]) -> Column:
    """The index-th choice; an index out of range fails the query."""
    out = F.when(index == 0, choices[0])
    for k, c in enumerate(choices[1:], 1):
        out = out.when(index == k, c)
    return out.otherwise(F.raise_error(F.lit("choose: index out of range")))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    both = F.isnan(a) & F.isnan(b)
    near = compare("==", a, b) | (is_finite(a) & is_finite(b) & (F.abs(a - b) <= atol + rtol * F.abs(b)))
    return near | (both if equal_nan else F.lit(False))


def uniform(seed: int, key: Column, low: float = 0.0, high: float = 1.0, draw: int = 0) -> Column:
    """A number in [low, high) from the seed and the row's key: the same whatever the partitioning."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), key), 11).cast("double") * F.lit(2.0**-53)
    return F.lit(low) + u * F.lit(high - low)


def normal(seed: int, key: Column, mean: float = 0.0, stddev: float = 1.0) -> Column:
    u, v = F.lit(1.0) - uniform(seed, key, draw=1), uniform(seed, key, draw=2)
    return F.lit(mean) + F.lit(stddev) * F.sqrt(-2.0 * F.ln(u)) * F.cos(2 * math.pi * v)


def randint(seed: int, key: Column, low: int, high: int) -> Column:
    return F.least(F.floor(uniform(seed, key) * (high - low)) + low, F.lit(high - 1)).cast("bigint")


def bernoulli(seed: int, key: Column, p: float = 0.5) -> Column:
    return uniform(seed, key) < p


def categorical(seed: int, key: Column, weights: list[float]) -> Column:
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be finite, not negative, with a positive sum")
    u, run, out = uniform(seed, key), 0.0, None
    for k, w in enumerate(weights[:-1]):
        run += w / sum(weights)
        out = F.when(u < run, k) if out is None else out.when(u < run, k)
    return (out.otherwise(len(weights) - 1) if out is not None else F.lit(0)).cast("bigint")


# ---- aggregates


def nan_min(x: Column) -> Column:
    return F.when(F.bool_or(F.isnan(x)), F.lit(NAN)).otherwise(F.min(x))


def nan_max(x: Column) -> Column:
    return F.max(x)


def wrapped_sum(x: Column, bits: int) -> Column:
    return wrap(F.sum(x.cast("decimal(38,0)")), bits)


def arg_extreme(x: Column, index: Column, largest: bool = False) -> Column:
    """The first index of the extreme; the first NaN wins."""
    key = F.when(F.isnan(x), F.lit(-INF)).otherwise(-x if largest else x)
    return F.min(F.struct((~F.isnan(x)).cast("int").alias("a"), key.alias("k"), index.alias("i")))["i"]


def variance(x: Column, ddof: int = 0) -> Column:
    n = F.count(x)
    return F.var_pop(x) if ddof == 0 else F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof).otherwise(1))
