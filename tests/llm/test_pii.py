import hashlib
import random
import re

from trivet.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    None, "", "mail a.b+c@d-e.co.uk, x@y, a@b.c_d@e.f @@ q@r.s.t.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00.000.0.255 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 1 2 3",
    "+1 (555) 010-9999 +49 30 123456 +1234 +12345678901234567 +1-555-010-99-99.", "é🙂 x@y.zz 日本 +44 20 7946 0958 — 10.0.0.1", "DE89 3704 0044 0532 0130 00 IBAN DE89370400440532013000", "aaaa." * 2000 + "@b.cc", "1" * 4000, "ssn 123-45-6789",
]


def luhn(ds):
    total = 0
    for i, d in enumerate(reversed(ds)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in p.finditer(text) if ok[k](m[0])]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x@y.zz", 1)], "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    for i, t in enumerate(TEXTS):
        base = brute(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t or "")[:60]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(base) <= set(spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone"))
    assert got[None].n_email == 1 and "iban" in got[7].spans
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_ibans_before_words_and_digits(spark):
    spaced, close = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    texts = {
        f"IBAN {spaced} Please pay": [spaced], f"{close} Thanks": [close], f"{close} BIC COBADEFF": [close], f"{spaced} IBAN {close}": [spaced, close],
        f"{close} 12 345": [close], f"{spaced}": [spaced], f"x {spaced} GB29 NWBK 6016 1331 9268 19 END": [spaced, "GB29 NWBK 6016 1331 9268 19"],
        "DE88370400440532013000 BIC": [], f"{close}a": [], f"A{close} B": [], "NO93 8601 1117 947 KR 100": ["NO93 8601 1117 947"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s["value"] for s in r.spans if s["kind"] == "iban"] for r in pii.find_pii(docs).collect()}
    assert got == dict(enumerate(texts.values()))
    at = {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["kind"] == "iban"] for r in pii.find_pii(docs).collect()}
    assert all([t[a:b] for a, b in at[i]] == want for i, (t, want) in enumerate(texts.items()))


def test_random_texts_and_repeated_rows(spark):
    rng = random.Random(8)
    pieces = ["a.b@c.dd", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+", "-", " ", "é", "🙂", "12", "7", "\n", "mail ", "phone: ", "card no "]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(400)]
    rows = [(i % 390, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    got = pii.pii_report(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")).collect()
    want = sorted((i, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        spans, scores = (x.split(",") if x else [] for x in (r.spans, r.scores))
        assert len(spans) == len(scores) and all(0 < float(s) <= 1 for s in scores)


def test_context_words_raise_scores(spark):
    texts = ["call 555-010-9999 now", "5550109999 or 555 010 9999", "ssn 123-45-6789", "number 123-45-6789"]
    got = {r.doc_id: {s["kind"]: round(s["score"], 2) for s in r.spans} for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].get("local_phone") == 0.7 and got[2].get("national_id") == 0.7
    assert "local_phone" not in got[1] and "national_id" not in got[3]
