"""Colour conversions and differences as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65), its inverse's rows, and the white point.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
DELTA = 6.0 / 29.0


def _inverse(m: tuple[tuple[float, ...], ...]) -> tuple[tuple[float, ...], ...]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (
        ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det),
        ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det),
        ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det),
    )


XYZ_TO_RGB = _inverse(RGB_TO_XYZ)


def _dot(weights: tuple[float, ...], values: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [F.lit(w) * v for w, v in zip(weights, values, strict=True)])


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), value))


def srgb_to_linear(channel: Column) -> Column:
    """An 8-bit channel as linear light."""
    v = channel / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(light: Column) -> Column:
    """Linear light, clipped to 0..1, as a channel of 0..1."""
    v = clamp(light, 0.0, 1.0)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    light = [srgb_to_linear(c) for c in (r, g, b)]

    def bend(t: Column) -> Column:
        return F.when(t > DELTA**3, F.cbrt(t)).otherwise(t / (3 * DELTA**2) + 4.0 / 29.0)

    x, y, z = (bend(_dot(row, light) / F.lit(w)) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit channels, rounded half to even."""
    fy = (lightness + 16.0) / 116.0

    def unbend(t: Column) -> Column:
        return F.when(t > DELTA, t * t * t).otherwise(3 * DELTA**2 * (t - 4.0 / 29.0))

    xyz = [F.lit(w) * unbend(t) for w, t in zip(WHITE, (fy + a / 500.0, fy, fy - b / 200.0), strict=True)]
    return tuple(F.rint(linear_to_srgb(_dot(row, xyz)) * 255.0).cast("int") for row in XYZ_TO_RGB)


def delta_e76(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(p - q) * (p - q) for p, q in zip(one, two, strict=True)]))


def delta_e2000(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """The published CIEDE2000 difference with all weights one."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    chroma = lambda a, b: F.sqrt(a * a + b * b)
    seven = lambda c: F.pow(c, F.lit(7.0))
    mean_c = (chroma(a1, b1) + chroma(a2, b2)) / 2.0
    lift = 1.0 + 0.5 * (1.0 - F.sqrt(seven(mean_c) / (seven(mean_c) + 25.0**7)))
    p1, p2 = a1 * lift, a2 * lift
    c1, c2 = chroma(p1, b1), chroma(p2, b2)

    def hue(a: Column, b: Column) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360.0).otherwise(h)

    h1, h2 = hue(p1, b1), hue(p2, b2)
    grey = c1 * c2 == 0
    turn = h2 - h1
    turn = F.when(grey, 0.0).when(turn > 180, turn - 360.0).when(turn < -180, turn + 360.0).otherwise(turn)
    d_h = 2.0 * F.sqrt(c1 * c2) * F.sin(F.radians(turn) / 2.0)
    total = h1 + h2
    mean_h = F.when(grey, total).when(F.abs(h1 - h2) <= 180, total / 2.0).when(total < 360, (total + 360.0) / 2.0).otherwise((total - 360.0) / 2.0)
    mean_l, mean_cp = (l1 + l2) / 2.0, (c1 + c2) / 2.0
    wave = lambda factor, shift: F.cos(F.radians(factor * mean_h + shift))
    t = 1.0 - 0.17 * wave(1.0, -30.0) + 0.24 * wave(2.0, 0.0) + 0.32 * wave(3.0, 6.0) - 0.20 * wave(4.0, -63.0)
    off = (mean_l - 50.0) * (mean_l - 50.0)
    s_l = 1.0 + 0.015 * off / F.sqrt(20.0 + off)
    s_c, s_h = 1.0 + 0.045 * mean_cp, 1.0 + 0.015 * mean_cp * t
    bell = F.exp(-F.pow((mean_h - 275.0) / 25.0, F.lit(2.0)))
    r_t = -F.sin(F.radians(60.0 * bell)) * 2.0 * F.sqrt(seven(mean_cp) / (seven(mean_cp) + 25.0**7))
    d_l, d_c = (l2 - l1) / s_l, (c2 - c1) / s_c
    return F.sqrt(F.greatest(F.lit(0.0), d_l * d_l + d_c * d_c + (d_h / s_h) * (d_h / s_h) + r_t * d_c * (d_h / s_h)))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)])


def preview_rgb(region_id: Column) -> tuple[Column, Column, Column]:
    """Stable false colours of region ids; id 0 is white."""
    return tuple(F.when(region_id == 0, 255).otherwise((region_id * k + s) % 223 + 24).cast("int") for k, s in ((67, 29), (131, 47), (197, 71)))


def key_rgb(key: Column) -> tuple[Column, Column, Column]:
    """Deterministic channels of an integer key."""
    return tuple(((key * k + s) % 256).cast("int") for k, s in ((67, 29), (131, 47), (197, 71)))


def blend(base: Column, over: Column, share: float) -> Column:
    """``share`` of ``over`` on ``base``, rounded half to even and clipped to a byte."""
    return clamp(F.rint(base * (1.0 - share) + over * share), 0.0, 255.0).cast("int")


