import datetime as dt
import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, **k):
    df = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, _m int")
    return [r for r in sorted(pii.op4(df, **k).collect(), key=lambda r: r.doc_id)]


def card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c) == 0)


RNG = random.Random(3)
CARDS = [card(RNG) for _ in range(60)]
IPS = [".".join(str(RNG.randint(0, 255)) for _ in range(4)) for _ in range(60)]
DATES = [(dt.date(1900, 1, 1) + dt.timedelta(RNG.randrange(73049))).isoformat() for _ in range(60)]
PHONES = [f"+1 ({RNG.randint(200, 999)}) 555-{RNG.randint(1000, 9999)}" for _ in range(60)]
MAILS = [f"{''.join(RNG.choice('abcxyz') for _ in range(5))}.{RNG.randint(0, 99)}@mail{i}.example.com" for i in range(60)]
SSNS = [f"{RNG.randint(1, 665):03}-{RNG.randint(1, 99):02}-{RNG.randint(1, 9999):04}" for _ in range(60)]
IBANS = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]


def test_formats_and_one_to_one(spark):
    kinds = [CARDS, IPS, DATES, PHONES, MAILS, SSNS, IBANS]
    got = [[r.text for r in run(spark, values)] for values in kinds]
    for values, new in zip(kinds, got):
        assert len(set(new)) == len(set(values))
        assert sum(a == b for a, b in zip(values, new)) <= 1
        for a, b in zip(values, new):
            assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) or values in (MAILS, IPS, IBANS)
    assert all(luhn(c) == 0 for c in got[0])
    assert all(0 <= int(o) < 256 and str(int(o)) == o for x in got[1] for o in x.split("."))
    assert all("1900" <= dt.date.fromisoformat(x).isoformat() < "2100" for x in got[2])
    assert all(x.startswith("+1 (") for x in got[3])
    assert all(b.split("@")[1] == a.split("@")[1] and re.sub("[a-z]", "a", re.sub("[0-9]", "0", b)) == re.sub("[a-z]", "a", re.sub("[0-9]", "0", a)) for a, b in zip(MAILS, got[4]))
    assert all(re.match(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$", x) for x in got[5])
    assert all(mod97(x) == 1 and x[:2] == a[:2] for a, x in zip(IBANS, got[6]))


def test_equal_values_stay_linked(spark):
    c = CARDS[0]
    spaced = " ".join(c[i : i + 4] for i in range(0, 16, 4))
    a, b, other = run(spark, [f"x {c} and {PHONES[0]}, ({MAILS[0]})", f"{spaced}\n{PHONES[0]} {MAILS[0]}.", f"é {c}"])
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(b.text.split("\n")[0]) == digits(other.text) and digits(other.text) in a.text
    phone, mail = b.text.split("\n")[1].split(") ")[0], b.text.split()[-1].rstrip(".")
    assert phone in a.text and mail in a.text and other.text.startswith("é ")
    assert (a.n_card, a.n_phone, a.n_email) == (1, 1, 1)
    assert run(spark, [c], key="another")[0].text != run(spark, [c])[0].text


def test_addresses_of_single_digits_alone(spark):
    alone = ["8.8.8.8", "see 1.1.1.1, then", "4.4.4.4\nand 8.8.8.8"]
    got, linked = run(spark, alone), run(spark, ["8.8.8.8 by 42"])[0]
    assert [r.n_ip for r in got] == [1, 1, 2]
    assert got[0].text != "8.8.8.8" and linked.text == got[0].text + " by 42" and got[2].text.endswith("and " + got[0].text)
    assert "1.1.1.1" not in got[1].text and got[1].text.startswith("see ")


def test_what_is_not_valid_stays(spark):
    texts = ["4041894974608796", "999.1.1.1", "1.2.3.4.5", "1981-02-29", "666-12-3456", "000-12-3456", "DE89 3702 0044 0532 0130 00", "mail@host", "12 apples, 345 pears", "", None, "no digits $1 \\2 here", "v1.2.3", "123456789012"]
    assert [r.text for r in run(spark, texts)] == texts
    assert all(sum(r[2:]) == 0 for r in run(spark, texts))


def test_dates_in_other_orders_link(spark):
    a, b, c = (r.text for r in run(spark, ["1980-02-28", "28.02.1980", "28/02/1980"]))
    d = dt.date.fromisoformat(a)
    assert b == d.strftime("%d.%m.%Y") and c == d.strftime("%d/%m/%Y") and a != "1980-02-28"


def test_long_text_plan_and_empty(spark):
    text = "word " * 50_000 + IPS[0] + " é" * 50_000 + IPS[0]
    new = run(spark, [text])[0]
    assert new.n_ip == 2 and IPS[0] not in new.text and len(new.text.split()) == len(text.split())
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.op4(df).count() == 0
    assert "Python" not in pii.op4(df)._jdf.queryExecution().toString()


def test_luhn_and_mod97_in_sql(spark):
    df = spark.createDataFrame([(c,) for c in CARDS[:20] + ["18", "26", "79927398713"]], "d string")
    assert all(r.x % 10 == luhn(r.d) for r in df.select("d", F.expr(pii.luhn("d")).alias("x")).collect())
    df = spark.createDataFrame([(i.replace(" ", ""),) for i in IBANS + ["DE00123456789"]], "d string")
    assert all(r.x == mod97(r.d) for r in df.select("d", F.expr(pii.mod97("d")).alias("x")).collect())


# A plain version of the whole operator: what is found, how it is judged, how it is permuted.

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SORTS = [
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,63}(?![A-Za-z])"),
    ("ip", pii.IP),
    ("date", pii.ISO),
    ("date", pii.DATE),
    ("ssn", pii.SSN),
    ("card", pii.CARD),
    ("phone", pii.PHONE.replace(r"\1", "(?P=sep)").replace("([ .-])", "(?P<sep>[ .-])")),
    ("iban", pii.IBAN),
]


def sha(kind, r, other):
    return bytes.fromhex(hashlib.sha256(f"quire|{kind}|{r}|{other}".encode()).hexdigest())


def shift_text(a, h):
    out = ""
    for i, ch in enumerate(a):
        for base, n in (("0", 10), ("a", 26), ("A", 26)):
            if ch.isascii() and ord(base) <= ord(ch) < ord(base) + n:
                ch = chr(ord(base) + (ord(ch) - ord(base) + h[i % 32]) % n)
                break
        out += ch
    return out


def network(s, kind):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(1, 9):
        a, b = b, shift_text(a, sha(kind, r, b))
    return a + b


def refill(m, p, of):
    it = iter(p)
    return "".join(next(it) if of(ch) else ch for ch in m)


def day_of(m):
    x = re.split("[-./]", m)
    y, month, d = x if m[4:5] == "-" else x[::-1]
    try:
        n = (dt.date(int(y), int(month), int(d)) - dt.date(1900, 1, 1)).days
    except ValueError:
        return None
    return n if 0 <= n < 73049 else None


def plain_kind(m):
    digits = re.sub("[^0-9]", "", m)
    full = lambda k: any(re.fullmatch(p, m) for name, p in SORTS if name == k)
    if "@" in m:
        return "email"
    if full("ip") and all(int(o) < 256 for o in m.split(".")):
        return "ip"
    if full("date") and day_of(m) is not None:
        return "date"
    if full("ssn") and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
        return "ssn"
    if full("card") and 13 <= len(digits) <= 19 and luhn(digits) == 0:
        return "card"
    if full("phone") and 10 <= len(digits) <= 15:
        return "phone"
    return "iban" if full("iban") and mod97(m) == 1 else None


def plain_new(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        name = m.split("@")[0]
        return network(name, "email") + m[len(name) :]
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
        for r in range(1, 9):
            a, b = b, (a + int.from_bytes(sha("ip", r, b)[:2])) % 65536
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        n = None
        while n is None or n >= 73049:
            a, b = divmod(day_of(m) if n is None else n, 270)
            for r in range(1, 5):
                a = (a + int(sha("high", r, b).hex()[:7], 16)) % 271
                b = (b + int(sha("low", r, a).hex()[:7], 16)) % 270
            n = a * 270 + b
        t = dt.date(1900, 1, 1) + dt.timedelta(n)
        return t.isoformat() if m[4:5] == "-" else t.strftime("%d/%m/%Y" if "/" in m else "%d.%m.%Y")
    if kind == "ssn":
        p = network(digits, "ssn")
        while p[:3] in ("000", "666") or p[0] == "9" or p[3:5] == "00" or p[5:] == "0000":
            p = network(p, "ssn")
        return refill(m, p, str.isdigit)
    if kind == "card":
        q = network(digits[:-1], "card")
        return refill(m, next(q + c for c in "0123456789" if luhn(q + c) == 0), str.isdigit)
    if kind == "phone":
        cut = max(0, len(digits) - 10)
        return refill(m, digits[:cut] + network(digits[cut:], "phone"), str.isdigit)
    bare = m.replace(" ", "")
    q = network(bare[4:], "iban")
    return refill(m, next(x for n in range(2, 99) if mod97(x := f"{bare[:2]}{n:02}{q}") == 1), lambda ch: ch != " ")


def plain(text):
    if text is None:
        return None, Counter()
    found, counts = re.compile("|".join(f"(?:{p})" for _, p in SORTS), re.ASCII), Counter()

    def one(m):
        kind = plain_kind(m[0])
        counts.update([kind] if kind else [])
        return plain_new(kind, m[0]) if kind else m[0]

    return found.sub(one, text), counts


def same_as_plain(spark, texts):
    for t, r in zip(texts, run(spark, texts), strict=True):
        want, counts = plain(t)
        assert r.text == want, t
        assert {k: getattr(r, f"n_{k}") for k in pii.KINDS} == {k: counts[k] for k in pii.KINDS}, t


def test_whole_texts_against_a_plain_version(spark):
    rng = random.Random(11)
    odd = ["a@b.com.", "a@b.com2", "..joe@x.org", "_k@x.de", "x" * 70 + "@y.com", "a@-b.com", "a@b-.com", "a@b.c", "a@b.co.3x", "A+b%c@d-e.f-1.museum", "a@b@c.com", "1.2.3.4.5", "04111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "(212) 555-0123", "212.555.0123", "212-555.0123", "+44 (20) 7946 0958", "+1", "DE89 3704 0044 0532 0130 00 5", "31.12.2099", "31/12/2100", "30.02.2000", "2000-02-30", "899-12-3456", "900-12-3456", "", None, "é@é.com", "user@exa_mple.com", "$1 \\2 " + IPS[0]]
    pieces = CARDS + IPS + DATES + PHONES + MAILS + SSNS + IBANS + [x for x in odd if x]
    mixed = ["".join(rng.choice(pieces) + rng.choice([" ", ", ", "\n", ".", "x", "(", ") ", "é"]) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    same_as_plain(spark, odd + mixed)


def test_documents_against_a_plain_version(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    same_as_plain(spark, texts)
    assert sum(sum(plain(t)[1].values()) for t in texts) > 0


BLOBS = ["a1B" * 350_000, "a@" + "b." * 20_000 + "com", "a." * 300_000, "9" * 1_000_000, "1." * 300_000, "A9B8 " * 200_000, "a@" * 200_000, "+1-" * 200_000, "(2" * 200_000, "-" * 500_000, "4111 " * 100_000]


def test_time_in_proportion_to_length(spark):
    df = spark.createDataFrame(list(enumerate(BLOBS)), "doc_id long, text string").repartition(4)
    pii.op4(df.limit(1)).collect()
    began = time.time()
    assert pii.op4(df).selectExpr("sum(n_email + n_iban) as n").count() == 1
    got = {r.doc_id: r.text for r in pii.op4(df).collect()}
    assert time.time() - began < 60
    assert got[0] == BLOBS[0] and got[1] == BLOBS[1] and got[3] == BLOBS[3]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "call 212-555-0123", "a", "b", "c")], "doc_id long, text string, _m string, _PII string, _doc string")
    got = pii.pseudonymised(df)
    assert got.columns == [*df.columns, "_pii_"]
    r = got.first()
    assert (r._m, r._PII, r._doc, r._pii_) == ("a", "b", "c", ["phone"]) and r.text != "call 212-555-0123"
