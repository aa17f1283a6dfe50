"""Scalar column functions of document analytics, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11, "print_high_res": 12}
UNITS = {"mm": (1.0, 25.4), "cm": (1.0, 2.54), "in": (1.0, 1.0), "px": (1.0, 96.0)}
SCHEMES = ("http", "https", "mailto", "tel", "ftp", "ftps")
#: What the web calls white space; Java's \s is ASCII only.
SPACES = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity, as scripts in documents do."""
    return F.floor(x + 0.5)


def roman(n: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3999; null outside."""
    out = F.lit("")
    for i, (value, sign) in enumerate(ROMAN):
        rest = n
        for v, _ in ROMAN[:i]:
            rest = F.pmod(rest, F.lit(v))
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
    return F.when((n >= 1) & (n <= 3999), out)


def alpha_label(n: Column) -> Column:
    """A to Z, then AA, BB: the letter repeats."""
    return F.when(n >= 1, F.repeat(F.char(F.pmod(n - 1, F.lit(26)) + 65), (F.floor((n - 1) / 26) + 1).cast("int")))


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """Prefix and number in the range's style (D, R, r, A, a; none: prefix alone)."""
    number = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", alpha_label(n)).when(style == "a", F.lower(alpha_label(n))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(number, F.lit("")))


def squeeze(text: Column) -> Column:
    """Runs of white space (any the web knows) become one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACES + "+", " "), "^ | \\z", "")


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def character_counts(text: str) -> Column:
    """array<struct<ch,n>>: how often each character stands in the texts of a column: for each one that there is, what the text is longer than without it."""
    distinct = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(distinct, lambda c: F.struct(c.alias("ch"), (F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))).cast("long").alias("n")))


def unligature(text: Column) -> Column:
    for k, v in LIGATURES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def safe_url(url: Column) -> Column:
    """The URL if its scheme is allowed or it has none; else null. Empty: null."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((u != "") & ((scheme == "") | scheme.isin(*SCHEMES)), u)


def to_points(length: Column) -> Column:
    """A length with its unit in points (1/72 inch); without a unit it is in points; unreadable: 0."""
    value = F.regexp_extract(length, "^ *(-?[0-9]*[.]?[0-9]+)", 1)
    n = F.coalesce(F.when(value != "", value.cast("double")), F.lit(0.0))
    unit = F.lower(F.regexp_extract(length, "([A-Za-z]+) *\\z", 1))
    out = F.when(unit == "", n).when(unit == "pt", n)
    for u, (a, b) in UNITS.items():
        out = out.when(unit == u, n * a / b * 72)
    return out.otherwise(n)


def plain_number(text: Column) -> Column:
    """A number out of decorated text: what is no digit, point or minus goes, then as much as reads as a number; else 0."""
    kept = F.regexp_extract(F.regexp_replace(text, "[^0-9.-]", ""), "^-?[0-9]*[.]?[0-9]+|^-?[0-9]+", 0)
    return F.coalesce(F.when(kept != "", kept.cast("double")), F.lit(0.0))


def permission(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(1 << (PERMISSIONS[name] - 1))) != 0


def direction(text: Column) -> Column:
    """rtl where right-to-left letters outnumber left-to-right ones."""
    rtl = F.length(F.regexp_replace(text, "[^\\u0590-\\u08FF\\uFB1D-\\uFDFF\\uFE70-\\uFEFC]", ""))
    ltr = F.length(F.regexp_replace(text, "[^A-Za-z\\u00C0-\\u024F\\u0370-\\u052F]", ""))
    return F.when(rtl > ltr, "rtl").otherwise("ltr")


def xml_unescape(text: Column) -> Column:
    """The five named entities; ampersands last, so that nothing is read twice."""
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def asn1_date(text: Column) -> Column:
    """YYYY-MM-DD of UTCTime (years from 50 on are 19xx) or GeneralizedTime; else null."""
    utc, general = text.rlike("^[0-9]{10,12}Z\\z"), text.rlike("^[0-9]{12,14}(?:[.][0-9]+)?Z\\z")
    year = F.when(F.substring(text, 1, 2).cast("int") >= 50, "19").otherwise("20")
    dashed = lambda y, at: F.concat_ws("-", y, F.substring(text, at, 2), F.substring(text, at + 2, 2))
    short = F.length(text) == 13
    return F.when(utc & short, dashed(F.concat(year, F.substring(text, 1, 2)), 3)).when(general, dashed(F.substring(text, 1, 4), 5)).when(utc, dashed(F.concat(year, F.substring(text, 1, 2)), 3))


def markdown_escape(text: Column) -> Column:
    """A leading # or > is escaped in a paragraph."""
    return F.regexp_replace(text, "^([#>])", "\\\\$1")


def cell_escape(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def quarter_turns(degrees: Column) -> Column:
    """Degrees to the next multiple of 90 in 0 to 270."""
    return F.pmod(half_up(degrees / 90) * 90, F.lit(360))


def to_screen(x: Column, y: Column, w: Column, h: Column, scale: Column, turn: Column) -> Column:
    """A page point (origin bottom left) on a screen (origin top left) turned clockwise: struct<x,y>."""
    at = [(0, x, h - y), (90, y, x), (180, w - x, y), (270, h - y, w - x)]
    out = None
    for t, a, b in at:
        point = F.struct((a * scale).alias("x"), (b * scale).alias("y"))
        out = F.when(turn == t, point) if out is None else out.when(turn == t, point)
    return out
