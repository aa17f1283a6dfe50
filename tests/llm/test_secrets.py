import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted((m.start(), ("assign", "access", "hex").index(k), m.end(), k) for k, m in out)


def good(body):
    return body + secrets.checksum(body[4:].encode()).decode()


GH = good("ghp_" + "a1B2c3" * 5)
BITS = ["password", "PassWd", "secret", "token=", "api_key", "APIKEY: ", "=", ":", " ", '"', "'", "abcdef012345", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN12", "é", "😀", "ſecret=", "x", "\n", "=abcdefghijkl", GH]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_base_spans_against_plain_regex(text):
    got = [(a, secrets.KINDS.index(k), b, k) for a, b, k in secrets.find(text) if k in secrets.KINDS[:3]]
    assert got == brute(text)


def test_checksums_decide():
    assert [k for *_, k in secrets.find(f"é {GH} and")] == ["github"]
    assert secrets.find(f"é {GH} and")[0][:2] == (2, 2 + len(GH))
    wrong = GH[:-1] + ("0" if GH[-1] != "0" else "1")
    assert secrets.find(wrong) == [] and secrets.find(GH + "x") == []
    assert [k for *_, k in secrets.find(good("npm_" + "Z9" * 15))] == ["npm"]


def test_query(spark):
    rows = [(1, None), (2, ""), (None, "token: 'abcdefghijklmnop'"), (4, "a\nsecret=AKIAABCDEFGHIJKLMN0 0123456789abcdef01"), (4, "plain"), (5, "é" * 70000 + " passwd=0123456789abcdef")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.op10(df).collect()}
    want = set()
    for d, t in rows:
        b = brute(t)
        s = ",".join(f"{k}:{x}:{y}" for x, _, y, k in b)
        n = [sum(k == w for *_, k in b) for w in ("assign", "access", "hex")]
        want.add((d, *n, hashlib.sha256(s.encode()).hexdigest(), s))
    assert got == want
    assert secrets.op10(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "my token=abcdefghijkl12 end", "en", "s", 27), (2, None, None, None, None), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert got[1].text == "my [assign] end" and got[1].n_chars == 15
    assert got[2].text is None and got[3].text == "clean"
    assert secrets.redacted(df).columns == df.columns
