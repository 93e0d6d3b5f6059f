"""Scalar functions of the splat pipeline, as Column expressions (double precision)."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pipeline.
RATE_LOW, RATE_HIGH, RATE_FLOOR = -20.0, 8.0, 1e-8
TILE = 16
ALPHA_CUT = 1.0 / 255.0
XY_STEP = 2.56
MIN_MSE = 1e-10
EPSILON = 1e-8


def clamp(v: Column, low: float | Column, high: float | Column) -> Column:
    """``v`` within [low, high]; NaN becomes ``low``."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.greatest(low, F.least(high, F.nanvl(v, low)))


def positive_or_zero(v: Column) -> Column:
    """Finite positive values; anything else (null, NaN, infinite, not positive) is 0."""
    return F.when(v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf")), 0.0).otherwise(v.cast("double"))


def rate(logit: Column) -> Column:
    return F.exp(clamp(logit, RATE_LOW, RATE_HIGH)) + F.lit(RATE_FLOOR)


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def scale_rotation(xx: Column, xy: Column, yy: Column, eps: float = EPSILON, reset: bool = True) -> dict[str, Column]:
    """Scales, rotation and unit vector of a symmetric log-covariance. ``reset``: no rotation for (nearly) isotropic ones."""
    mean, half = (xx + yy) / 2.0, (xx - yy) / 2.0
    radius = F.sqrt(half * half + xy * xy + F.lit(eps * eps))
    angle = F.atan2(2.0 * xy, xx - yy) * -0.5
    if reset:
        angle = F.when(radius <= eps, 0.0).otherwise(angle)
    return {"s_major": F.exp((mean + radius) * 0.5), "s_minor": F.exp((mean - radius) * 0.5), "theta": angle, "ux": F.cos(angle), "uy": F.sin(angle)}


def exp_symmetric(xx: Column, xy: Column, yy: Column, low: float = -20.0, high: float = 20.0) -> dict[str, Column]:
    """The matrix exponential of a symmetric 2x2 matrix, with eigenvalues held in [low, high]; NaN entries count as 0."""
    xx, xy, yy = (F.nanvl(v, F.lit(0.0)) for v in (xx, xy, yy))
    mean, half = (xx + yy) / 2.0, (xx - yy) / 2.0
    radius = F.sqrt(half * half + xy * xy + F.lit(EPSILON * EPSILON))
    high_log, low_log = clamp(mean + radius, low, high), clamp(mean - radius, low, high)
    slope = (F.exp(high_log) - F.exp(low_log)) / F.greatest(2.0 * radius, F.lit(EPSILON))
    close = F.exp(clamp(mean, low, high))
    near = radius <= 1e-5  # the difference quotient would cancel
    base = F.when(near, close * (1.0 - mean)).otherwise(F.exp(high_log) - slope * high_log)
    slope = F.when(near, close).otherwise(slope)
    return {"c_xx": base + slope * xx, "c_xy": slope * xy, "c_yy": base + slope * yy}


def anisotropy(s_major: Column, s_minor: Column) -> Column:
    high, low = F.greatest(s_major, s_minor), F.least(s_major, s_minor)
    return F.greatest(F.lit(1.0), high / F.greatest(low, F.lit(1e-8)))


def conic(s1: Column, s2: Column, theta: Column) -> dict[str, Column]:
    """Covariance of rotated scales, its inverse (null where it has none) and the footprint radius in pixels."""
    c, s = F.cos(theta), F.sin(theta)
    a, b = s1 * s1, s2 * s2
    xx, xy, yy = c * c * a + s * s * b, c * s * (b - a), s * s * a + c * c * b
    det = xx * yy - xy * xy
    inverse = F.when(det != 0, F.lit(1.0) / F.when(det != 0, det))
    mid = (xx + yy) / 2.0
    top = mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))
    return {"s_xx": xx, "s_xy": xy, "s_yy": yy, "q_xx": yy * inverse, "q_xy": -xy * inverse, "q_yy": xx * inverse, "radius": F.ceil(3.0 * F.sqrt(top)).cast("int")}


def cutoff_extent(variance: Column) -> Column:
    """Half the width beyond which a splat is under 1/255."""
    return F.sqrt(F.lit(2.0 * log(255.0)) * variance)


def alpha(dx: Column, dy: Column, q_xx: Column, q_xy: Column, q_yy: Column) -> Column:
    power = (q_xx * dx * dx + q_yy * dy * dy) * 0.5 + q_xy * dx * dy
    a = F.exp(-power)
    return F.when((power >= 0) & (a >= ALPHA_CUT), a).otherwise(0.0)


def tile_range(center: Column, radius: Column, size: int) -> tuple[Column, Column]:
    """First and past-the-last tile that a footprint touches along one axis; fractions are cut towards zero."""
    tiles = -(-size // TILE)
    first = ((center - radius) / TILE).cast("int")
    last = ((center + radius) / TILE + 1.0).cast("int")
    return (F.least(F.lit(tiles), F.greatest(F.lit(0), v)) for v in (first, last))


def morton(x: Column, y: Column, bits: int = 6) -> Column:
    """Interleaved bits of x (even places) and y (odd places)."""
    out = F.lit(0)
    for k in range(bits):
        for axis, at in ((x, 2 * k), (y, 2 * k + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(axis, k).bitwiseAND(F.lit(1)), at))
    return out


def hilbert(x: Column, y: Column, side: int) -> Column:
    """Distance along the Hilbert curve of the power-of-two square ``side``."""
    levels = F.expr(f"transform(sequence(1, {max(1, side.bit_length() - 1)}), i -> cast(shiftright({side}, i) as bigint))")
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(acc: Column, s: Column) -> Column:
        rx, ry = acc["x"].bitwiseAND(s) > 0, acc["y"].bitwiseAND(s) > 0
        quadrant = F.when(rx, F.when(ry, 2).otherwise(3)).otherwise(F.when(ry, 1).otherwise(0))
        flip = rx & ~ry
        fx, fy = F.when(flip, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(flip, s - 1 - acc["y"]).otherwise(acc["y"])
        nx, ny = F.when(ry, acc["x"]).otherwise(fy), F.when(ry, acc["y"]).otherwise(fx)
        return F.struct((acc["d"] + s * s * quadrant).alias("d"), nx.cast("long").alias("x"), ny.cast("long").alias("y"))

    return F.aggregate(levels, start, step)["d"]


def fixed_point(v: Column) -> Column:
    """32.32 fixed point, so that sums do not depend on their order."""
    return F.floor(v * F.lit(float(1 << 32))).cast("decimal(38,0)")


def from_fixed_point(v: Column) -> Column:
    return v.cast("double") / float(1 << 32)


def psnr(mse: Column, infinite_at_zero: bool = False) -> Column:
    value = F.log10(F.greatest(mse, F.lit(MIN_MSE))) * -10.0
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(value) if infinite_at_zero else value


def count_shift(n_auto: Column, n: Column) -> Column:
    """What is added to the diagonal of the log-covariance when more points are asked for than there would be."""
    return F.when(n > n_auto, F.log(n_auto / n)).otherwise(0.0)


def parse_size(text: Column) -> dict[str, Column]:
    """Width and height of ``SIZE`` or ``WxH`` (also ``W*H``); null unless both are positive."""
    pattern = r"^\s*([0-9]{1,9})\s*(?:[xX*]\s*([0-9]{1,9})\s*)?$"
    w, second = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    w = F.when(w != "", w.cast("int"))
    h = F.when(second != "", second.cast("int")).otherwise(w)
    good = (w > 0) & (h > 0)
    return {"width": F.when(good, w), "height": F.when(good, h)}


def order_key(value: Column, index: Column) -> Column:
    """A long that orders like (value as a 32-bit float, index): the bits of the float, turned so that they order as integers, above the index (0 to 2^31 - 1). Minus zero is zero."""
    bits = float_bits(value)
    turned = F.when(bits >= F.lit(1 << 31), F.lit((1 << 32) - 1) - bits).otherwise(bits + F.lit(1 << 31))
    return F.shiftleft(turned - F.lit(1 << 31), 31).bitwiseOR(index.cast("long"))


def float_bits(value: Column) -> Column:
    """The 32 bits of a float as a long from 0, by arithmetic on its parts; for finite values."""
    v = value.cast("float").cast("double")
    size = F.abs(v)
    least = 2.0**-126
    exponent = F.when(size < least, F.lit(-126)).otherwise(F.floor(F.log2(F.greatest(size, F.lit(least))))).cast("int")
    exponent = exponent + F.when(size >= F.pow(F.lit(2.0), exponent + 1), 1).when((size < F.pow(F.lit(2.0), exponent)) & (size >= least), -1).otherwise(0)
    fraction = size / F.pow(F.lit(2.0), exponent)
    parts = F.when(size < least, F.rint(size * 2.0**149)).otherwise((exponent + 127) * float(1 << 23) + F.rint((fraction - 1) * float(1 << 23)))
    return (parts + F.when(v < 0, float(1 << 31)).otherwise(0.0)).cast("long")
