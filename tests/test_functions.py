import hashlib
import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trivet.functions import jsonx, tools
from trivet.functions import text as T


def entropy(v):
    n = len(v or "")
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0.0


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select("*", *[c.alias(k) for k, c in cols.items()]).collect()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=30))
def test_entropy_and_length(spark, values):
    values = [v if v is None else v.encode("utf-8", "ignore").decode() for v in values]
    for r in one(spark, [(v,) for v in values], "v string", e=T.entropy(F.col("v")), f=T.features(F.col("v"))):
        assert r.e == pytest.approx(entropy(r.v), abs=1e-9)
        assert r.f.length == len(r.v or "") and r.f.entropy == pytest.approx(r.e)


def test_normalisation(spark):
    cases = {None: "REVIEW", "": "REVIEW", " real ": "REAL", "false positive": "FALSE_POSITIVE", "odd": "REVIEW", " REVIEW\x1c": "REVIEW"}
    got = {r.v: r.s for r in one(spark, [(v,) for v in cases], "v string", s=T.normalize_status(F.col("v")))}
    assert got == cases
    fields = {None: None, "None": None, ' "abc", ': "abc", "'x'": "x", '"': None, "''": None, "null": None, "a,b,,": "a,b", " \t": None, '" q "': "q"}
    got = {r.v: r.c for r in one(spark, [(v,) for v in fields], "v string", c=T.clean_field(F.col("v")))}
    assert got == fields
    r = one(spark, [("abc", None)], "v string, c string", h=T.value_hash(F.col("v")), n=T.value_hash(F.col("c")), k=T.context_hash(F.col("c")))[0]
    assert r.h == hashlib.sha256(b"abc").hexdigest()[:16] and r.n is None and r.k == "sha256:" + hashlib.sha256(b"").hexdigest()


def test_tools(spark):
    rows = [("Your_Password", "DB_PASS=1 user login at https://x INC123", "Tests\\prod\\a.env"), (None, None, None)]
    got = one(spark, rows, "v string, c string, p string", t=tools.placeholder_terms(F.col("v")), s=tools.context_signals(F.col("c")), k=tools.path_class(F.col("p")))
    assert got[0].t == ["your_"] and got[0].k == "test_fixture"
    s = got[0].s.asDict()
    assert not s["has_password_key"] and s["has_username"] and s["has_ticket"] and s["has_url"]
    assert got[1].t == [] and got[1].k == "source" and not any(got[1].s)


def test_json_objects_and_decisions(spark):
    texts = ['{"a": 1}', 'x {bad} y {"status": "REAL", "agent_trace": {"t": [{"u": {}}]}} z', "[1]", "", None, '{"status": "FALSE_POSITIVE", "is_credentials": 1, "confidence": 7}']
    got = one(spark, [(t,) for t in texts], "t string", o=jsonx.json_object(F.col("t")), d=jsonx.decision(jsonx.json_object(F.col("t")), F.lit("s"), F.lit("m")))
    assert [r.o is not None for r in got] == [True, True, False, False, False, True]
    assert got[1].d.status == "REAL" and got[1].d.is_credentials == 1 and got[1].d.json_valid
    assert got[4].d.status == "REVIEW" and got[4].d.evidence == ["llm_error"] and not got[4].d.json_valid
    assert got[5].d.label_conflict and got[5].d.confidence == 1.0


def test_grounding_and_rationale(spark):
    rows = [(["near host", "seen in billing", "zz", " "], "the billing host"), ([], "x"), (["near x"], "")]
    got = one(spark, rows, "e array<string>, t string", g=jsonx.grounding_score(F.col("e"), F.col("t")), s=jsonx.grounding_score(F.col("e"), F.col("t"), strict=True))
    assert [(r.g, r.s) for r in got] == [(0.5, 0.5), (0.0, 0.0), (1.0, 0.0)]
    answers = [('{"reasoning": " why ", "evidence": ["1","2","3","4","5","6"]}',), ('{"reasoning": "  "}',), (None,)]
    got = one(spark, answers, "t string", r=jsonx.rationale(F.col("t")))
    assert got[0].r.reasoning == "why" and len(got[0].r.evidence) == 5 and got[1].r is None and got[2].r is None


def test_prompt_round_trip_and_completion(spark):
    p = T.prompt(F.col("f"), F.col("s"), F.lit("K"), F.col("v"), F.col("c"))
    r = one(spark, [("a b.txt", None, "v|1", "line\nContext:\nmore")], "f string, s string, v string, c string", p=p)[0]
    assert r.p == "File: a b.txt | Source: unknown\nPattern: K | Match: v|1\nContext:\nline\nContext:\nmore"
    back = one(spark, [(r.p,)], "p string", f=T.prompt_field(F.col("p"), "file_path"), c=T.prompt_field(F.col("p"), "context"), v=T.prompt_field(F.col("p"), "matched_value"))[0]
    assert (back.f, back.v, back.c) == ("a b.txt", "v|1", "line\nContext:\nmore")
