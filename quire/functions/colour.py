"""Colour conversions as column arithmetic, from published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


# A published approximation of printing inks, for red, green and blue the weights of these products, added to 255.
CMYK_TERMS = ("cc", "cm", "cy", "ck", "c", "mm", "my", "mk", "m", "yy", "yk", "y", "kk", "k")
CMYK = (
    (-4.387332384609988, 54.48615194189176, 18.82290502165302, 212.25662451639585, -285.2331026137004, 1.7149763477362134, -5.6096736904047315, -17.873870861415444, -5.497006427196366, -2.5217340131683033, -21.248923337353073, 17.5119270841813, -21.86122147463605, -198.14),
    (8.841041422036149, 60.118027045597366, 6.871425592049007, 31.159100130055922, -79.2970844816548, -15.310361306967817, 17.575251261109482, 131.35250912493976, -190.9453302588951, 4.444339102852739, 9.8632861493405, -24.86741582555878, -20.737325471181034, -203.26),
    (0.8842522430003296, 8.078677503112928, 30.89978309703729, -0.23883238689178934, -14.183576799673286, 10.49593273432072, 63.02378494754052, 50.606957656360734, -112.23884253719248, 0.03296041114873217, 115.60384449646641, -193.58209356861505, -22.33816807309886, -200.66),
)


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct<r,g,b> in 0 to 1."""
    v = {"c": _clamp(c), "m": _clamp(m), "y": _clamp(y), "k": _clamp(k)}
    out = []
    for name, row in zip("rgb", CMYK, strict=True):
        total = F.lit(255.0)
        for weight, term in zip(row, CMYK_TERMS, strict=True):
            product = v[term[0]] * v[term[1]] if len(term) == 2 else v[term]
            total = total + F.lit(weight) * product
        out.append(_clamp(total / 255).alias(name))
    return F.struct(*out)


def _encoded(v: Column) -> Column:
    """sRGB's transfer of a linear value."""
    v = _clamp(v)
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def xyz_rgb(x: Column, y: Column, z: Column) -> Column:
    """CIE XYZ (D65) to sRGB."""
    r = 3.2406 * x - 1.5372 * y - 0.4986 * z
    g = -0.9689 * x + 1.8758 * y + 0.0415 * z
    b = 0.0557 * x - 0.2040 * y + 1.0570 * z
    return F.struct(_encoded(r).alias("r"), _encoded(g).alias("g"), _encoded(b).alias("b"))


def lab_rgb(lightness: Column, a: Column, b: Column, white: tuple[float, float, float] = (0.9505, 1.0, 1.089)) -> Column:
    """CIE L*a*b* to sRGB; white is taken as the display's."""
    m = (lightness + 16) / 116

    def back(t: Column) -> Column:
        return F.when(t >= 6 / 29, t * t * t).otherwise(108 / 841 * (t - 4 / 29))

    return xyz_rgb(white[0] * back(m + a / 500), white[1] * back(m), white[2] * back(m - b / 200))


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b
