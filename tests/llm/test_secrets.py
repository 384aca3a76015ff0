import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from trivet.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SECRET = 'password = "abcdefghijkl1234'


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def spans(text, **more):
    return {(text[a:b], how) for (_, a, b), how in secrets.Scan(text, **more).spans.items()}


WRAPS = {
    "url": urllib.parse.quote,
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": b64,
    "base64 utf-16": lambda t: b64(t.encode("utf-16-le")),
    "base64>gzip": lambda t: b64(gzip.compress(t.encode())),
    "base64>zlib": lambda t: b64(zlib.compress(t.encode())),
    "base64>bzip2": lambda t: b64(bz2.compress(t.encode())),
    "base64>xz": lambda t: b64(lzma.compress(t.encode())),
    "base64>zstd": lambda t: b64(zstandard.compress(t.encode())),
    "base64>gzip>bzip2": lambda t: b64(gzip.compress(bz2.compress(t.encode()))),
    "url>gzip": lambda t: "".join(f"%{c:02x}" for c in gzip.compress(t.encode())),
    "unicode>zlib": lambda t: "".join(f"\\x{c:02x}" for c in zlib.compress(t.encode())),
}


@pytest.mark.parametrize("how", WRAPS)
def test_each_wrapping_is_opened(how):
    text = f"see ({WRAPS[how](SECRET)}) there"
    assert any(h == how and s for s, h in spans(text)), spans(text)


@pytest.mark.parametrize("outer", [h for h in WRAPS if h != "base64 utf-16"])
def test_wrappings_of_wrappings(outer):
    for inner in ("url", "unicode", "base64", "base64>zlib"):
        found = spans(f"({WRAPS[outer](WRAPS[inner](SECRET))})")
        assert any(h in (f"{outer}>{inner}", inner) for _, h in found), (outer, inner, found)


def test_spans_are_those_of_the_text():
    assert (f"{urllib.parse.quote(SECRET)}", "url") in spans(f"é🙂 {urllib.parse.quote(SECRET)} x")
    assert ("tok\\x65n: abcdefghijklmnop%3D%3D", "unicode>url") in spans("a tok\\x65n: abcdefghijklmnop%3D%3D b")
    wrapped = b64("éé 🙂 " + SECRET + " and more of it")
    (found,) = spans(f"x {wrapped} y")
    at = wrapped.index(found[0])
    assert SECRET.encode() in base64.b64decode("A" * (at % 4) + found[0] + "A" * (-(at + len(found[0])) % 4))
    lines = base64.encodebytes((SECRET + ". ").encode() * 9).decode()
    assert list(secrets.Scan(lines).spans.values()) == ["base64"] * 9
    assert (WRAPS["url"]("\\") + "u0070assword=abcdefghijklm", "url>unicode") in spans("%5Cu0070assword=abcdefghijklm")
    assert ("password=\\ud83d", "") not in spans("password=\\ud83d\\ude00abcdefghijklmn")


def test_paths_and_either_alphabet():
    token = base64.urlsafe_b64encode((SECRET + "?>>~~").encode()).decode()
    for text in (f"https://host/{token}/end", f"/{b64(SECRET)}", f"x-{b64(SECRET)}-y"):
        assert any(h == "base64" for _, h in spans(text)), text


def test_cycles_and_bombs_end():
    scan = secrets.Scan(b64(zlib.compress(b"a" * 5_000_000)), 1_000_000)
    assert scan.unopened == 1 and not scan.spans
    assert secrets.Scan(b64(zlib.compress(b"a " * 100 + SECRET.encode())), 1_000_000).spans
    text = SECRET
    for _ in range(30):
        text = urllib.parse.quote(text)
    assert (text, ">".join(["url"] * 30)) in spans(text)
    scan = secrets.Scan("\\u0025" * 50 + "41" * 50)
    assert scan.layers < 20


def test_an_archive_of_itself_ends(monkeypatch):
    """A stream whose content is the stream again."""
    monkeypatch.setattr(secrets, "unpacked", lambda raw, most: ("gzip", raw) if raw[:2] == b"\x1f\x8b" else None)
    assert secrets.Scan(b64(gzip.compress(b"x" * 40))).layers == 1


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        base, row = brute(text or ""), got[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(row.spans.split(","))


def test_odd_rows(spark):
    rng = random.Random(2)
    bits = ["token", "secret: ", "TOKEN=", "api_key", "apikey:'", "AKIA", "0f" * 9, "ABCDEFGHIJKLMNOPQR", "K", "toKen=abcdefghijklmnop", "ſecret=abcdefghijklmnop", " ", '"', "=", "é", "🙂", "deadbeef" * 3]
    texts = ["", None, "\x00" * 20, "%", "%zz\\u12", "=" * 50, "a" * 100_000, "token: secret: abcdefghijklmnop", "AKIAAKIA" + "X" * 14] + ["".join(rng.choices(bits, k=12)) for _ in range(300)]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, SECRET, "x"), (7, texts[7], "x")], "doc_id long, text string, spans string")
    got = secrets.secrets_report(table).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        base = brute(SECRET if r.doc_id is None else texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert secrets.secrets_report(table.limit(0)).count() == 0
