"""Color expressions on 8-bit channels: luma, HSV, CIE Lab, curves, palettes.

Lab is on the 8-bit scale: lightness times 255/100, chroma shifted by 128.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65), its inverse, the white point, and the lightness weight of palette distances.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
XYZ_TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)
LIGHT_WEIGHT = 0.35


def clip(x: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def to_byte(x: Column) -> Column:
    """Clip to 0..255 and cut off the fraction."""
    return clip(x).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def _linear(v: Column) -> Column:
    x = v.cast("double") / 255.0
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)


def _gamma(x: Column) -> Column:
    return F.when(x > 0.0031308, 1.055 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * x)


def _f(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = [_linear(c) for c in (r, g, b)]
    x, y, z = ((m[0] * lin[0] + m[1] * lin[1] + m[2] * lin[2]) / w for m, w in zip(RGB_TO_XYZ, WHITE))
    light = F.when(y > 0.008856, 116.0 * F.pow(y, F.lit(1.0 / 3.0)) - 16.0).otherwise(903.3 * y)
    return light * 255.0 / 100.0, 500.0 * (_f(x) - _f(y)) + 128.0, 200.0 * (_f(y) - _f(z)) + 128.0


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Back to channels, clipped and cut off."""
    star = light * 100.0 / 255.0
    y = F.when(star > 7.9996, F.pow((star + 16.0) / 116.0, F.lit(3.0))).otherwise(star / 903.3)
    fy = F.when(star > 7.9996, (star + 16.0) / 116.0).otherwise(7.787 * y + 16.0 / 116.0)
    fx, fz = fy + (a - 128.0) / 500.0, fy - (b - 128.0) / 200.0
    xyz = [w * F.when(f > 0.2068966, F.pow(f, F.lit(3.0))).otherwise((f - 16.0 / 116.0) / 7.787) for f, w in ((fx, WHITE[0]), (fz, WHITE[2]))]
    lin = [m[0] * xyz[0] + m[1] * y + m[2] * xyz[1] for m in XYZ_TO_RGB]
    return tuple(to_byte(255.0 * _gamma(v) + 1e-6) for v in lin)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..180, saturation and value in 0..255, all unrounded."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, 60.0 * (g - b) / d).when(top == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    return F.when(hue < 0, hue + 360.0).otherwise(hue) / 2.0, F.when(top == 0, 0.0).otherwise(255.0 * d / top), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    part = h * 2.0 / 60.0
    i = F.floor(part).cast("int") % 6
    f, t = part - F.floor(part), s / 255.0
    p, q, u = v * (1.0 - t), v * (1.0 - t * f), v * (1.0 - t * (1.0 - f))

    def pick(*six: Column) -> Column:
        out = F.when(i == 0, six[0])
        for k in range(1, 5):
            out = out.when(i == k, six[k])
        return F.floor(clip(out.otherwise(six[5])) + 0.5).cast("int")

    return pick(v, q, p, p, u, v), pick(u, v, v, q, p, p), pick(p, p, u, v, v, q)


def hsv_shift(r: Column, g: Column, b: Column, shift: float, saturation: float, gamma: float) -> tuple[Column, Column, Column]:
    """Turn the hue, scale the saturation, bend the value."""
    h, s, v = rgb_to_hsv(r, g, b)
    return hsv_to_rgb((h + shift) % 180.0, clip(s * saturation), 255.0 * F.pow(v / 255.0, F.lit(gamma)))


def curve(v: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear tone curve by a table of 256 entries, built from its knots."""
    table = []
    for x in range(256):
        k = max(i for i in range(len(knots) - 1) if knots[i][0] <= x or i == 0)
        (x0, y0), (x1, y1) = knots[k], knots[k + 1]
        table.append(int(min(255.0, max(0.0, y0 + (x - x0) * (y1 - y0) / (x1 - x0)))))
    return F.element_at(F.array(*(F.lit(t) for t in table)), v.cast("int") + 1)


def match_moments(x: Column, mean: Column, std: Column, to_mean: Column, to_std: Column) -> Column:
    """Give a channel another mean and deviation."""
    return (x - mean) / std * to_std + to_mean


def palette_distance(p: list[Column], c: list[Column]) -> Column:
    """Squared distance of two Lab colors with less weight on lightness."""
    d = [x - y for x, y in zip(p, c)]
    return LIGHT_WEIGHT * d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def soft_weights(distances: Column, tau: float = 60.0) -> Column:
    """Softmax of negative distances, shifted by the least one."""
    least = F.array_min(distances)
    raw = F.transform(distances, lambda d: F.exp((least - d) / tau))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def fit_palette(palette: Column, n: Column | int) -> Column:
    """``n`` colors at evenly spaced ranks of a palette sorted by lightness (halves round to even)."""
    n = F.lit(n) if isinstance(n, int) else n
    ordered = F.array_sort(palette)
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n > 1, F.bround(i * (F.size(palette) - 1) / (n - 1)).cast("int")).otherwise(F.lit(0)))
    return F.transform(at, lambda i: F.element_at(ordered, i + 1))
