"""Colour spaces as pure Column expressions. Channels are columns; top is the channel's maximum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ITU-R BT.601 and BT.2020 luma weights, CIE XYZ of linear sRGB, D65 white point.
BT601 = (0.299, 0.587, 0.114)
BT2020 = (0.2627, 0.6780, 0.0593)
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
LAB_EPS, LAB_SLOPE, LAB_SHIFT = 0.008856, 7.787, 16.0 / 116.0
# Range of L, a and b over the RGB cube, for normalised Lab.
LAB_RANGE = ((0.0, 99.998337), (86.182236, 184.440850), (107.867744, 202.349426))

Triple = tuple[Column, Column, Column]


def luminance(r: Column, g: Column, b: Column, w=BT601) -> Column:
    return r * w[0] + g * w[1] + b * w[2]


def rgb_to_ycbcr(r: Column, g: Column, b: Column, top: float = 255.0, w=BT601) -> Triple:
    """Full-range YCbCr, chroma around (top + 1) / 2."""
    y, mid = luminance(r, g, b, w), (top + 1) / 2
    return y, (b - y) / (2 * (1 - w[2])) + mid, (r - y) / (2 * (1 - w[0])) + mid


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, top: float = 255.0, w=BT601) -> Triple:
    mid = (top + 1) / 2
    r, b = y + (cr - mid) * (2 * (1 - w[0])), y + (cb - mid) * (2 * (1 - w[2]))
    return r, (y - r * w[0] - b * w[2]) / w[1], b


def rgb_to_hsv(r: Column, g: Column, b: Column, top: float = 255.0) -> Triple:
    """Hue in degrees, saturation and value in 0..1."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return h * 60.0, F.when(hi > 0, d / hi).otherwise(0.0), hi / top


def hsv_to_rgb(h: Column, s: Column, v: Column, top: float = 255.0) -> Triple:
    def channel(n: int) -> Column:
        k = F.pmod(h / 60.0 + n, F.lit(6.0))
        return (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * top

    return channel(5), channel(3), channel(1)


def rgb_to_lab(r: Column, g: Column, b: Column, top: Column | float = 255.0) -> Triple:
    """L*a*b* of linear RGB divided by ``top`` (a number, or a column as an image's maximum)."""
    c = [x / top for x in (r, g, b)]

    def f(t: Column) -> Column:
        return F.when(t > LAB_EPS, F.cbrt(t)).otherwise(t * LAB_SLOPE + LAB_SHIFT)

    x, y, z = (f((c[0] * m[0] + c[1] * m[1] + c[2] * m[2]) / w) for m, w in zip(XYZ, WHITE))
    yy = (c[0] * XYZ[1][0] + c[1] * XYZ[1][1] + c[2] * XYZ[1][2]) / WHITE[1]
    return F.when(yy > LAB_EPS, y * 116 - 16).otherwise(yy * 903.3), (x - y) * 500, (y - z) * 200


def rgb_to_lab_normalized(r: Column, g: Column, b: Column, top: Column | float = 255.0) -> Triple:
    """As ``rgb_to_lab``, each channel scaled to 0..1."""
    return tuple((v + shift) / width for v, (shift, width) in zip(rgb_to_lab(r, g, b, top), LAB_RANGE))  # type: ignore[return-value]


def lab_to_rgb(L: Column, a: Column, b: Column, top: float = 255.0) -> Triple:  # noqa: N803
    y = (L + 16) / 116
    x, z = a / 500 + y, y - b / 200

    def inv(t: Column) -> Column:
        return F.when(t * t * t > LAB_EPS, t * t * t).otherwise((t - LAB_SHIFT) / LAB_SLOPE)

    X, Y, Z = inv(x) * WHITE[0], inv(y) * WHITE[1], inv(z) * WHITE[2]  # noqa: N806
    # Inverse of XYZ above.
    inverse = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
    return tuple((X * m[0] + Y * m[1] + Z * m[2]) * top for m in inverse)  # type: ignore[return-value]


def hex_to_rgb(c: Column) -> Triple:
    """Channels of '#RRGGBB' (any case, '#' optional); null for other texts."""
    h = F.regexp_extract(F.upper(c), "^#?([0-9A-F]{6})$", 1)
    return tuple(F.when(h != "", F.conv(F.substring(h, i, 2), 16, 10).cast("int")) for i in (1, 3, 5))  # type: ignore[return-value]


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])


def blue_to_red(v: Column, top: float = 255.0) -> Triple:
    """Heat colours: blue for 0 over green to red for ``top``; channels 0..255."""
    t = v / top * 4

    def clip(c: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int")

    return clip(F.lit(1.5) - F.abs(t - 3)), clip(F.lit(1.5) - F.abs(t - 2)), clip(F.lit(1.5) - F.abs(t - 1))


def quantized_bin(r: Column, g: Column, b: Column, per_channel: int, top: float = 255.0) -> Column:
    """Bin of the RGB cube cut in ``per_channel`` ** 3 cells: r + n g + n n b."""
    q = [F.least(F.floor(c * per_channel / (top + 1)), F.lit(per_channel - 1)).cast("int") for c in (r, g, b)]
    return q[0] + q[1] * per_channel + q[2] * per_channel * per_channel


def gray_table(v: Column, top: float = 255.0) -> Triple:
    """Gray colours: black for 0, white for ``top``; channels 0..255."""
    g = F.round(v / top * 255).cast("int")
    return g, g, g


def hot_table(v: Column, top: float = 255.0) -> Triple:
    """Black over red and yellow to white, a third of the range each; channels 0..255."""
    t = v / top * 3
    return tuple(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t - i)) * 255).cast("int") for i in range(3))  # type: ignore[return-value]


def categorical(k: Column) -> Triple:
    """A colour for each label from 1: hues by steps of the golden ratio; black for 0."""
    golden = (5**0.5 - 1) / 2
    rgb = hsv_to_rgb((k * golden) % 1.0 * 360, F.lit(0.8), F.when(k > 0, 1.0).otherwise(0.0))
    return tuple(F.round(c).cast("int") for c in rgb)  # type: ignore[return-value]
