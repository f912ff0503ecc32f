"""Colour space conversions as column expressions. Channels are in 0..1 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r: Column, g: Column, b: Column) -> Column:
    """Midpoint of the least and the greatest channel (0..255), in 0..1."""
    return (F.least(r, g, b) + F.greatest(r, g, b)) / F.lit(2.0) / F.lit(255.0)


def gray_linear(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = (0.3, 0.59, 0.11)) -> Column:
    return (r * weights[0] + g * weights[1] + b * weights[2]) / F.lit(255.0)


def mono(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(F.least(r, g, b) + F.greatest(r, g, b), 1)


def pack24(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack24(x: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(x, s).bitwiseAND(255) for s in (16, 8, 0))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..1, chroma (the second channel is not divided by the value), value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, F.lit(0.0)).when(top == r, F.try_divide(g - b, d)).when(top == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4) / 6
    return F.when(h < 0, h + 1).otherwise(h), d, top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """From hue in 0..1 (1 is 0 again), saturation as a share of the value, value."""
    x = (h - F.floor(h)) * 6
    i = F.floor(x)
    f = x - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))

    def pick(*six: Column) -> Column:
        out = F.when(i == 0, six[0])
        for k in range(1, 5):
            out = out.when(i == k, six[k])
        return out.otherwise(six[5])

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


# The YUV matrix of ITU-R BT.601 and its inverse.
def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return r * 0.299 + g * 0.587 + b * 0.114, r * -0.14713 + g * -0.28886 + b * 0.436, r * 0.615 + g * -0.51499 + b * -0.10001


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    return y + v * 1.13983, y + u * -0.39465 + v * -0.5806, y + u * 2.03211


# The same in 256ths for whole channels of 0 to 255, luminance from 16 on and colour differences around 128.
def rgb_to_whole_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    part = lambda x, y, z: F.shiftright((r * x + g * y + b * z + 128).cast("long"), 8)
    return part(66, 129, 25) + 16, part(-38, -74, 112) + 128, part(112, -94, -18) + 128


def whole_yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Channels are cut to 0 to 255."""
    part = lambda a, b: F.greatest(F.least(F.shiftright(((y - 16) * 298 + (u - 128) * a + (v - 128) * b + 128).cast("long"), 8), F.lit(255)), F.lit(0)).cast("long")
    return part(0, 409), part(-100, -208), part(516, 0)


# Rec. 709 RGB to XYZ at the D65 white point and back, and the CIE L*a*b* constants.
WHITE = (0.950456, 1.0, 1.088754)
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
EPSILON, EDGE, KAPPA, SLOPE = 0.008856, 0.206893, 903.3, 7.787
# The lightness below which a and b fade and that takes its place, and the greatest b.
DARK, YELLOW = 20.0, 70.0


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Dark colours fade: below DARK, a and b shrink by e for each quarter of DARK and the lightness is DARK."""

    def share(k: int) -> Column:
        return (r * TO_XYZ[k][0] + g * TO_XYZ[k][1] + b * TO_XYZ[k][2]) / WHITE[k]

    def f(t: Column) -> Column:
        return F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise(t * SLOPE + 16 / 116)

    x, y, z = (f(share(k)) for k in range(3))
    light = F.when(share(1) > EPSILON, y * 116 - 16).otherwise(share(1) * KAPPA)
    fade = F.when(light < DARK, F.exp((light - DARK) / (DARK / 4))).otherwise(F.lit(1.0))
    return F.greatest(light, F.lit(DARK)), (x - y) * 500 * fade, F.least((y - z) * 200 * fade, F.lit(YELLOW))


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Channels are held to 0..1. Faded colours don't come back as they were."""
    cube = F.pow((lightness + 16) / 116, F.lit(3.0))
    y = F.when(cube < EPSILON, lightness / KAPPA).otherwise(cube)
    fy = F.when(y > EPSILON, F.pow(y, F.lit(1 / 3))).otherwise(y * SLOPE + 16 / 116)

    def back(t: Column) -> Column:
        return F.when(t > EDGE, t * t * t).otherwise((t - 16 / 116) / SLOPE)

    xyz = back(a / 500 + fy) * WHITE[0], y, back(fy - b / 200) * WHITE[2]
    return tuple(F.least(F.greatest(xyz[0] * m[0] + xyz[1] * m[1] + xyz[2] * m[2], F.lit(0.0)), F.lit(1.0)) for m in FROM_XYZ)


def rgb_to_chromaticity(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Shares of red and green, and the sum (0 shares where the sum is 0)."""
    s = r + g + b
    return F.coalesce(F.try_divide(r, s), F.lit(0.0)), F.coalesce(F.try_divide(g, s), F.lit(0.0)), s


def chromaticity_to_rgb(r: Column, g: Column, s: Column) -> tuple[Column, Column, Column]:
    return r * s, g * s, (1 - r - g) * s


def heat(v: Column) -> tuple[Column, Column, Column]:
    """Blue over green to red for 0..1, with green at a half."""
    low = v <= 0.5
    return F.when(low, F.lit(0.0)).otherwise(2 * v - 1), F.when(low, 2 * v).otherwise(2 - 2 * v), F.when(low, 1 - 2 * v).otherwise(F.lit(0.0))


def label_to_color(label: Column) -> tuple[Column, Column, Column]:
    """Deal the bits of a label to the channels in turn, the lowest to the highest bits of a channel."""

    def channel(k: int) -> Column:
        out = F.lit(0)
        for j in range(8):
            if 3 * j + k < 31:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(label, 3 * j + k).bitwiseAND(1), 7 - j))
        return out

    return channel(0), channel(1), channel(2)


def color_to_label(r: Column, g: Column, b: Column) -> Column:
    out = F.lit(0)
    for k, channel in enumerate((r, g, b)):
        for j in range(8):
            if 3 * j + k < 31:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(channel, 7 - j).bitwiseAND(1), 3 * j + k))
    return out
