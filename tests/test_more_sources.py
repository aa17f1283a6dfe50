import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import colour
from quire.functions import signature as sg
from quire.sources import cmaps
from quire.sources.pdf.colours import cmyk
from quire.sources.pdf import reader
from quire.sources.xfa import read_xfa, to_points
from quire.streaming.ingest import ingest
from tests.pdfmaker import report


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def oid(s):
    a = list(map(int, s.split(".")))
    out = bytes([a[0] * 40 + a[1]])
    for n in a[2:]:
        part = [n & 127]
        while n := n >> 7:
            part.insert(0, n & 127 | 128)
        out += bytes(part)
    return der(6, out)


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def prime(rng, bits):
    while True:
        p = rng.getrandbits(bits) | 1 | 3 << (bits - 2)
        if all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7, 11)):
            return p


def message(data, algorithm, spki, sign):
    """A PKCS#7 message over data: sign gives the signature of the attributes' bytes."""
    sha = der(0x30, oid("2.16.840.1.101.3.4.2.1"))
    name = der(0x30, der(0x31, der(0x30, oid(sg.COMMON_NAME), der(12, b"Ada"))))
    tbs = der(0x30, der(0xA0, number(2)), number(7), algorithm, name, der(0x30), name, spki)
    cert = der(0x30, tbs, algorithm, der(3, b"\0"))
    attrs = der(0x30, oid(sg.DIGEST), der(0x31, der(4, hashlib.sha256(data).digest())))
    info = der(0x30, number(1), der(0x30, name, number(7)), sha, der(0xA0, attrs), algorithm, der(4, sign(der(0x31, attrs))))
    body = der(0x30, number(1), der(0x31, sha), der(0x30, oid("1.2.840.113549.1.7.1")), der(0xA0, cert), der(0x31, info))
    return der(0x30, oid("1.2.840.113549.1.7.2"), der(0xA0, body))


def rsa_key(n, e, kind=sg.RSA):
    return der(0x30, der(0x30, oid(kind), der(5)), der(3, b"\0", der(0x30, number(n), number(e))))


def signed(data, key, rng):
    n, e, d = key

    def sign(raw):
        want = bytes.fromhex(sg._PREFIX["sha256"]) + hashlib.sha256(raw).digest()
        size = (n.bit_length() + 7) // 8
        m = int.from_bytes(b"\0\1" + b"\xff" * (size - len(want) - 3) + b"\0" + want, "big")
        return pow(m, d, n).to_bytes(size, "big")

    return message(data, der(0x30, oid(sg.RSA), der(5)), rsa_key(n, e), sign)


SHA256 = "2.16.840.1.101.3.4.2.1"


@pytest.mark.parametrize("salt,kind", [(32, sg.RSA), (0, sg.PSS), (20, sg.PSS)])
def test_pss_signatures(salt, kind):
    rng = random.Random(3)
    p, q = prime(rng, 512), prime(rng, 513)
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))

    def sign(raw, wrong=0):
        """EMSA-PSS by its description."""
        bits, digest, own = n.bit_length() - 1, hashlib.sha256(raw).digest(), rng.randbytes(salt)
        size = (bits + 7) // 8
        h = hashlib.sha256(bytes(8) + digest + own).digest()
        db = bytes(size - salt - 34) + b"\1" + own
        hidden = bytearray(a ^ b for a, b in zip(db, sg.mask(h, len(db), "sha256")))
        hidden[0] &= 0xFF >> (8 * size - bits)
        m = bytes(hidden) + h + b"\xbc"
        return pow(int.from_bytes(m, "big") + wrong, d, n).to_bytes((n.bit_length() + 7) // 8, "big")

    hashed = der(0x30, oid(SHA256))
    params = der(0x30, der(0xA0, hashed), der(0xA1, der(0x30, oid("1.2.840.113549.1.1.8"), hashed)), der(0xA2, number(salt)))
    algorithm = der(0x30, oid(sg.PSS), params)
    good = sg.check(message(b"data", algorithm, rsa_key(n, 65537, kind), sign), b"data")
    assert (good["intact"], good["verified"], good["reason"]) == (True, True, "")
    assert sg.check(message(b"data", algorithm, rsa_key(n, 65537, kind), lambda raw: sign(raw, 1 << 300)), b"data")["verified"] is False


@pytest.mark.parametrize("curve", sg.CURVES)
def test_elliptic_signatures(curve):
    c = sg.CURVES[curve]
    assert (c.y**2 - c.x**3 + 3 * c.x - c.b) % c.p == 0 and sg.multiplied(c, c.n, (c.x, c.y)) is None
    secret, once, size = 0x1234567890ABCDEF77, 0xFEDCBA0987654321, (c.p.bit_length() + 7) // 8
    x, y = sg.multiplied(c, secret, (c.x, c.y))
    spki = der(0x30, der(0x30, oid(sg.EC_KEY), oid(curve)), der(3, b"\0\4" + x.to_bytes(size, "big") + y.to_bytes(size, "big")))

    def sign(raw, wrong=0):
        r = sg.multiplied(c, once, (c.x, c.y))[0] % c.n
        z = int.from_bytes(hashlib.sha256(raw).digest(), "big")
        return der(0x30, number(r), number(pow(once, -1, c.n) * (z + r * secret) % c.n + wrong))

    algorithm = der(0x30, oid("1.2.840.10045.4.3.2"))
    assert sg.check(message(b"data", algorithm, spki, sign), b"data")["verified"] is True
    assert sg.check(message(b"data", algorithm, spki, lambda raw: sign(raw, 1)), b"data")["verified"] is False
    assert sg.check(message(b"data", algorithm, spki, sign), b"other")["intact"] is False
    unknown = der(0x30, der(0x30, oid(sg.EC_KEY), oid("1.3.132.0.10")), der(3, b"\0\4"))
    assert sg.check(message(b"data", algorithm, unknown, sign), b"data")["verified"] is None


def test_signatures():
    rng = random.Random(1)
    p, q = prime(rng, 512), prime(rng, 512)
    key = (p * q, 65537, pow(65537, -1, (p - 1) * (q - 1)))
    s = signed(b"the signed bytes", key, rng)
    good = sg.check(s, b"the signed bytes")
    assert (good["intact"], good["verified"], good["hash"], good["signer"]) == (True, True, "sha256", "Ada")
    assert sg.check(s, b"the signed bytez")["intact"] is False
    other = (key[0], 65537, key[2] + 2)
    assert sg.check(signed(b"x", other, rng), b"x")["verified"] is False
    assert sg.check(b"\x30\x03", b"")["intact"] is None


CMAP = "/CMapName /Test def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n3 begincidrange\n<0010> <001F> 100\n<0020> <002F> 116\n<0050> <0050> 7\nendcidrange\n1 begincidchar\n<0060> 9\nendcidchar\n"


def test_cmaps(spark, tmp_path):
    (tmp_path / "m").write_text(CMAP)
    assert cmaps.parse(CMAP) == ([(2, 0, 0xFFFF)], [(16, 47, 2, 100), (80, 80, 2, 7), (96, 96, 2, 9)])
    ranges = cmaps.read_cmaps(spark, str(tmp_path))
    codes = spark.createDataFrame([("Test", c) for c in (0, 16, 47, 48, 80, 81, 96)] + [("None", 16)], "name string, code long")
    assert sorted((r.name, r.code, r.cid) for r in cmaps.to_cids(codes, ranges).collect()) == [("None", 16, 0), ("Test", 0, 0), ("Test", 16, 100), ("Test", 47, 131), ("Test", 48, 0), ("Test", 80, 7), ("Test", 81, 0), ("Test", 96, 9)]


def test_colours(spark):
    one = spark.range(1)
    r = one.select(colour.cmyk_rgb(*map(F.lit, (1.0, 0.0, 0.5, 0.5))).alias("c"), colour.lab_rgb(*map(F.lit, (100.0, 0.0, 0.0))).alias("w"), colour.lab_rgb(*map(F.lit, (0.0, 0.0, 0.0))).alias("k"), colour.lab_rgb(*map(F.lit, (53.24, 80.09, 67.2))).alias("red")).first()
    # Inks by the polynomial, worked out by hand for green: 255 + (8.841 + 3.436 + 15.580 - 79.297) + (1.111 + 2.466 - 12.434) + (-5.184 - 101.63).
    assert abs(r.c.g - 87.888 / 255) < 1e-4 and all(abs(a - b) < 1e-12 for a, b in zip(r.c, cmyk(1.0, 0.0, 0.5, 0.5)))
    assert all(abs(x - 1) < 0.01 for x in r.w) and max(r.k) < 0.001
    assert r.red.r > 0.99 and r.red.g < 0.05 and r.red.b < 0.05


XFA = """<xdp><template><subform name="form" layout="tb"><pageSet><pageArea><contentArea x="10mm" y="20pt" w="500pt" h="100pt"/><medium short="612pt" long="792pt"/></pageArea></pageSet>
<draw name="t" w="100pt" h="20pt"><value><text>Invoice</text></value><font size="14pt" weight="bold"/></draw>
<subform name="item" layout="lr-tb" h="20pt"><occur min="0" max="-1"/><field name="what" w="100pt" h="20pt"/><field name="cost" w="50pt" h="20pt"><caption reserve="20pt"><value><text>EUR</text></value></caption></field></subform>
<field name="gone" presence="hidden" h="20pt"/><field name="total" w="90pt" h="20pt"><calculate><script>Sum(cost[*])</script></calculate></field></subform></template>
<datasets><data><form><item><what>Pen</what><cost>2</cost></item><item><what>Ink &amp; pad</what><cost>3.5</cost></item><item><what>Map</what><cost>4</cost></item></form></data></datasets></xdp>"""


def test_xfa():
    boxes, stats = read_xfa(XFA)
    assert [b["text"] for b in boxes] == ["Invoice", "Pen", "EUR", "2", "Ink & pad", "EUR", "3.5", "Map", "EUR", "4", "9.5"]
    assert stats == {"fields": 7, "draws": 1, "repeats": 2, "scripts_skipped": 0}
    assert [b["page"] for b in boxes if b["name"] in ("what", "total")] == [1, 1, 1, 1] and boxes[-1]["y"] == 100
    assert boxes[0]["bold"] and boxes[0]["size"] == 14 and to_points("1in") == 72 and read_xfa("no xml <") == ([], {})


def test_xfa_repeats_by_data_without_a_cap():
    for most in ("-1", "2600"):
        items = "".join(f"<o><k>{k}</k></o>" for k in range(2500))
        xml = f'<xdp><template><subform name="f" layout="tb"><subform name="o" layout="tb"><occur min="0" max="{most}"/><field name="k" h="10pt"/></subform></subform></template><datasets><data><f>{items}</f></data></datasets></xdp>'
        boxes, stats = read_xfa(xml)
        assert [b["text"] for b in boxes] == [str(k) for k in range(2500)] and stats["repeats"] == 2499


def test_xfa_layout_of_a_hot_customer(spark, tmp_path):
    from quire.plans.documents import xfa_layout

    orders = [(1, k) for k in range(2300)] + [(2, k) for k in range(3)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, xfa_layout(spark, str(tmp_path)).collect())) == [(1, 2300, float(sum(range(2300)))), (2, 3, 3.0)]


def test_arriving_files(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.pdf").write_bytes(report(3))
    (src / "copy.pdf").write_bytes(report(3))
    run = lambda: ingest(spark, str(src), str(out), str(tmp_path / "check")).awaitTermination(120)
    run()
    assert spark.read.parquet(f"{out}/documents").count() == 1 and spark.read.parquet(f"{out}/pages").count() == 3
    (src / "b.pdf").write_bytes(report(2))
    (src / "again.pdf").write_bytes(report(3))
    run()
    run()
    assert spark.read.parquet(f"{out}/documents").count() == 2
    assert reader.SCHEMAS["pages"].startswith("doc_id")


def event(activity, code, kind="application/x-javascript"):
    return f'<event activity="{activity}"><script contentType="{kind}">{code}</script></event>'


def test_xfa_event_scripts():
    fields = "".join(f'<field name="{n}" h="10pt">{more}</field>' for n, more in (
        ("a", ""),
        ("b", event("initialize", 'this.rawValue = a.rawValue + "!"; xfa.host.messageBox("hello");')),
        ("c", event("calculate", 'a.presence = "hidden";')),
        ("d", event("ready", "xfa.resolveNode('f.row').instanceManager.setInstances(3);")),
        ("e", event("click", 'this.rawValue = "never";') + event("initialize", "nosuch.thing();") + event("initialize", "x = 1", "application/x-formcalc")),
    ))
    xml = f'<xdp><template><subform name="f" layout="tb">{fields}<subform name="row" layout="tb"><occur min="1" max="-1"/><field name="r" h="10pt"/></subform></subform></template><datasets><data><f><a>one</a><e>five</e></f></data></datasets></xdp>'
    boxes, stats = read_xfa(xml)
    assert [(b["name"], b["text"]) for b in boxes] == [("b", "one!"), ("c", ""), ("d", ""), ("e", "five"), *[("r", "")] * 3]
    assert stats["messages"] == 1 and stats["scripts_skipped"] == 1
