"""Operator 4: format-preserving pseudonyms for personal data, in SQL expressions alone.

Found by pattern and validated: e-mail addresses, IPv4 addresses (octets to 255), card
numbers (Luhn), phone numbers, social security numbers (areas in use), IBANs (mod 97)
and calendar dates. What fails its validation stays.

A value is permuted by a keyed Feistel network within its format: two halves take turns
in being shifted by a hash of the other, so that the map is one-to-one for each key, and
equal values have equal pseudonyms in all documents, however they are punctuated:

* digits: the halves are digit strings, shifted digit by digit modulo 10
* e-mail names and account numbers: letters shift within their case modulo 26
* IPv4: two 16-bit halves; dates: days of 1900 to 2099 as a pair modulo 271 and 270,
  walked on until they fall into the range; social security numbers walk to areas in use
* card and IBAN check digits are computed anew; phone numbers keep the digits before
  the last ten; e-mail domains stay; punctuation stays where it is

Null text: null, no counts. Texts without candidates come through as they are, and very
long ones take time in proportion to their length. Rows that repeat a doc_id are
documents of their own; an empty table gives no rows. Where patterns meet, the leftmost
match counts, and of those that begin there the first in ANY.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh

KEY = "quire"
ROUNDS = 8
#: Every pattern has a bound on what it reads from one place, and none goes on a place from which it has read before without
#: end, so texts take time in proportion to their length. Limits are those of the standards: 64 characters before the @,
#: 63 in a label of a domain, 126 labels and a last one of letters; what is longer is no address.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?<!-)\.){1,126}[A-Za-z]{2,63}+(?![A-Za-z])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DATE = r"(?<![0-9./])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9]|[./][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "ip": IP, "date": f"(?:{ISO}|{DATE})", "ssn": SSN, "card": CARD, "phone": PHONE, "iban": IBAN}
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IP, ISO, DATE, SSN, CARD, PHONE, IBAN))
_FIRST_DAY, _DAYS, _HIGH, _LOW = "DATE'1900-01-01'", 73049, 271, 270


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hash(key: str, kind: str, r: str, other: str) -> str:
    return f"sha2(concat_ws('|', {_quoted(key)}, '{kind}', cast({r} as string), {other}), 256)"


def _byte(h: str, i: str) -> str:
    return f"cast(conv(substring({h}, ({i}) % 32 * 2 + 1, 2), 16, 10) as int)"


def _shifted(a: str, h: str) -> str:
    """Characters of a, each shifted within its class by a byte of the hash h."""
    step = lambda base, n: f"chr({base} + (ascii(ch) - {base} + {_byte(h, 'i')}) % {n})"
    one = f"CASE WHEN ch BETWEEN '0' AND '9' THEN {step(48, 10)} WHEN ch BETWEEN 'a' AND 'z' THEN {step(97, 26)} WHEN ch BETWEEN 'A' AND 'Z' THEN {step(65, 26)} ELSE ch END"
    return f"array_join(transform(filter(split({a}, ''), ch -> ch <> ''), (ch, i) -> {one}), '')"


def feistel(s: str, key: str, kind: str) -> str:
    """SQL: the string s permuted among strings of its length and classes."""
    half = f"cast(length({s}) / 2 as int)"
    start = f"named_struct('a', substring({s}, 1, {half}), 'b', substring({s}, {half} + 1))"
    h = _let("h", _hash(key, kind, "r", "f.b"), _shifted("f.a", "h"))
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (f, r) -> named_struct('a', f.b, 'b', {h}), f -> concat(f.a, f.b))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _bare(m: str) -> str:
    return f"replace({m}, ' ', '')"


def _put(m: str, p: str, of: str = "BETWEEN '0' AND '9'") -> str:
    """The characters of p in place of those of m that are of the class, in order."""
    step = f"named_struct('o', concat(f.o, IF(ch {of}, substring({p}, f.k, 1), ch)), 'k', f.k + IF(ch {of}, 1, 0))"
    return f"aggregate(filter(split({m}, ''), ch -> ch <> ''), named_struct('o', '', 'k', 1), (f, ch) -> {step}, f -> f.o)"


def luhn(d: str, shift: int = 0) -> str:
    """SQL: the Luhn sum of a digit string; shift 1 where the check digit is yet to follow."""
    x = f"cast(ch as int) * (1 + (i + {shift}) % 2)"
    return f"aggregate(transform(filter(split(reverse({d}), ''), ch -> ch <> ''), (ch, i) -> {x} - IF({x} > 9, 9, 0)), 0, (f, x) -> f + x)"


def mod97(s: str) -> str:
    """SQL: an IBAN's remainder, its first four characters moved to the end, letters as 10 to 35."""
    moved = f"concat(substring({s}, 5), substring({s}, 1, 4))"
    return f"aggregate(filter(split({moved}, ''), ch -> ch <> ''), 0, (f, ch) -> IF(ch BETWEEN '0' AND '9', (f * 10 + ascii(ch) - 48) % 97, (f * 100 + ascii(ch) - 55) % 97))"


def _card(m: str, key: str) -> str:
    payload = "substring(d, 1, length(d) - 1)"
    p = _let("q", feistel(payload, key, "card"), f"concat(q, cast(pmod(-({luhn('q', 1)}), 10) as string))")
    return _let("d", _digits(m), _let("p", p, _put(m, "p")))


def _phone(m: str, key: str) -> str:
    keep = "greatest(0, length(d) - 10)"
    p = f"concat(substring(d, 1, {keep}), {_let('u', f'substring(d, {keep} + 1)', feistel('u', key, 'phone'))})"
    return _let("d", _digits(m), _let("p", p, _put(m, "p")))


_SSN_OK = r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"


def _ssn(m: str, key: str) -> str:
    walk = f"aggregate(sequence(1, 24), {feistel('d', key, 'ssn')}, (g, w) -> IF(g RLIKE {_quoted(_SSN_OK)}, g, {feistel('g', key, 'ssn')}))"
    return _let("d", _digits(m), _let("p", walk, _put(m, "p")))


def _ip(m: str, key: str) -> str:
    o = [f"cast(element_at(split({m}, '[.]'), {i}) as int)" for i in (1, 2, 3, 4)]
    shift = f"cast(conv(substring({_hash(key, 'ip', 'r', 'cast(f.b as string)')}, 1, 4), 16, 10) as int)"
    start = f"named_struct('a', {o[0]} * 256 + {o[1]}, 'b', {o[2]} * 256 + {o[3]})"
    show = "concat_ws('.', cast(f.a div 256 as string), cast(f.a % 256 as string), cast(f.b div 256 as string), cast(f.b % 256 as string))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (f, r) -> named_struct('a', f.b, 'b', (f.a + {shift}) % 65536), f -> {show})"


def _day(m: str) -> str:
    """SQL: the days since the first day, null if it is no date in range."""
    part = lambda i: f"cast(element_at(split({m}, '[-./]'), {i}) as int)"
    iso = f"substring({m}, 5, 1) = '-'"
    y, month, d = f"IF({iso}, {part(1)}, {part(3)})", part(2), f"IF({iso}, {part(3)}, {part(1)})"
    day = f"datediff(try_to_timestamp(concat_ws('-', lpad(cast({y} as string), 4, '0'), lpad(cast({month} as string), 2, '0'), lpad(cast({d} as string), 2, '0')), 'yyyy-MM-dd'), {_FIRST_DAY})"
    return _let("day", day, f"IF(day >= 0 AND day < {_DAYS}, day, null)")


def _date(m: str, key: str) -> str:
    """Days are paired as (high, low); each in turn is shifted by a hash of the other, modulo its own range."""
    shift = lambda kind, x: f"cast(conv(substring({_hash(key, kind, 'r', f'cast({x} as string)')}, 1, 7), 16, 10) as long)"
    high = f"cast(pmod(f.a + {shift('high', 'f.b')}, {_HIGH}) as int)"
    step = _let("a", high, f"named_struct('a', a, 'b', cast(pmod(f.b + {shift('low', 'a')}, {_LOW}) as int))")
    once = lambda x: f"aggregate(sequence(1, {ROUNDS // 2}), named_struct('a', cast({x} div {_LOW} as int), 'b', cast({x} % {_LOW} as int)), (f, r) -> {step}, f -> f.a * {_LOW} + f.b)"
    walk = f"aggregate(sequence(1, 16), {once('day')}, (g, w) -> IF(g < {_DAYS}, g, {once('g')}))"
    show = f"CASE WHEN substring({m}, 5, 1) = '-' THEN date_format(t, 'yyyy-MM-dd') WHEN {m} LIKE '%/%' THEN date_format(t, 'dd/MM/yyyy') ELSE date_format(t, 'dd.MM.yyyy') END"
    return _let("day", _day(m), _let("t", f"date_add({_FIRST_DAY}, {walk})", show))


def _email(m: str, key: str) -> str:
    return _let("u", f"substring_index({m}, '@', 1)", f"concat({feistel('u', key, 'email')}, substring({m}, length(u) + 1))")


def _iban(m: str, key: str) -> str:
    check = "lpad(cast(98 - " + mod97("concat(substring(d, 1, 2), '00', q)") + " as string), 2, '0')"
    p = _let("q", feistel("substring(d, 5)", key, "iban"), f"concat(substring(d, 1, 2), {check}, q)")
    return _let("d", _bare(m), _let("p", p, _put(m, "p", "<> ' '")))


def _kind(m: str) -> str:
    """SQL: the kind that m is, validated; null if none."""
    full = lambda k: f"{m} RLIKE {_quoted('^(?:' + KINDS[k] + ')$')}"
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) < 256)"
    cases = [
        ("email", f"{m} LIKE '%@%'"),
        ("ip", f"{full('ip')} AND {octets}"),
        ("date", f"({full('date')}) AND {_day(m)} IS NOT NULL"),
        ("ssn", f"{full('ssn')} AND {_digits(m)} RLIKE {_quoted(_SSN_OK)}"),
        ("card", f"{full('card')} AND length({_digits(m)}) BETWEEN 13 AND 19 AND ({luhn(_digits(m))}) % 10 = 0"),
        ("phone", f"{full('phone')} AND length({_digits(m)}) BETWEEN 10 AND 15"),
        ("iban", f"{full('iban')} AND ({mod97(_bare(m))}) = 1"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in cases) + " END"


def pseudonym(kind: str, m: str, key: str) -> str:
    """SQL: the pseudonym of m (a column or variable) of that kind (the same)."""
    of = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "iban": _iban}
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {f(m, key)}" for k, f in of.items()) + f" ELSE {m} END"


def pseudonymised(docs: DataFrame, key: str = KEY, kinds: str = "_pii") -> DataFrame:
    """docs with pseudonyms in text, and as the last column the kinds found there, in order (null where nothing was looked for).

    That column has the name in kinds, with underscores behind it where docs has a column of that name; other columns,
    whatever their names, come through."""
    # All patterns but EMAIL and IP need two digits in a row; an address may have four octets of one digit.
    text = F.col("_doc.text")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    found = d.select("_doc", F.when(text.rlike("[0-9]{2}|@|[0-9][.][0-9]"), F.expr(f"regexp_extract_all(_doc.text, {_quoted(ANY)}, 0)")).alias("_m"))
    found = found.select("*", F.when(F.size("_m") > 0, F.expr(f"transform(_m, m -> named_struct('k', {_kind('m')}, 'm', m))")).alias("_k"))
    new = F.expr(f"array_join(zip_with(split(_doc.text, {_quoted(ANY)}, -1), transform(_k, v -> {pseudonym('v.k', 'v.m', key)}), (g, p) -> concat(g, coalesce(p, ''))), '')")
    changed = F.expr("exists(_k, v -> v.k is not null)")
    out = [F.when(changed, new).otherwise(text).alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    return found.select(*out, F.expr("filter(transform(_k, v -> v.k), k -> k is not null)").alias(fresh(docs, kinds)))


def op4(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and how many values of each kind were replaced."""
    own = pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    count = lambda k: F.coalesce(F.size(F.filter("_pii", lambda x: x == k)), F.lit(0)).cast("long")
    return own.select("doc_id", "text", *(count(k).alias(f"n_{k}") for k in KINDS))
