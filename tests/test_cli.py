import http.server
import json
import threading

from trivet import cli
from trivet.plans import artifacts


def test_commands(spark, tmp_path, capsys):
    out = lambda name: str(tmp_path / name)
    cli.main(["generate", "--out-dir", out("gen"), "--n-tp", "40", "--n-fp", "40", "--n-review", "10"])
    assert spark.read.json(out("gen") + "/records").count() == 90
    (tmp_path / "d.json").write_text(json.dumps([{"file_path": "a", "owner": "o", "source": "s", "pattern_name": "P", "matched_value": "Kx82!pQ", "context": "c"}]))
    cli.main(["triage", "--input", out("d.json"), "--output", out("t")])
    assert spark.read.json(out("t") + "/owners").first().total == 1
    (item,) = [r for r in spark.read.text(out("t") + "/nested").collect()]
    assert json.loads(item.value)["files"]["a"][0]["pattern_name"] == "P"
    for name, rows in (("tp", [("key=abcDEF123!", None, "abcDEF123!")]), ("fp", [("policy text", None, None), ("x@y.example mail", None, None)])):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"{name}.txt").write_text(f"dataset = {rows!r}")
    cli.main(["build", "--source-tp", out("src/tp.txt"), "--source-fp", out("src/fp.txt"), "--out-dir", out("b")])
    cli.main(["benchmark", "--test", out("b") + "/merged_records", "--output", out("m"), "--strategies", "direct_json", "few_shot"])
    assert spark.read.json(out("m") + "/summary").count() == 2
    cli.main(["distill", "--input", out("b") + "/train", "--output", out("r")])
    cli.main(["distill", "--input", out("b") + "/train", "--output", out("r"), "--resume"])
    assert spark.read.json(out("r")).count() == spark.read.json(artifacts.artifact(spark, out("b"), "train")).count()
    cli.main(["smoke"])
    assert '"total": 7' in capsys.readouterr().out


def test_commands_with_a_model_behind_an_endpoint(spark, tmp_path):
    """Triage, benchmark and distillation ask an endpoint, a distinct prompt once; rows of the benchmark have latencies."""
    asked, lock = [], threading.Lock()

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                asked.append((body["model"], body["messages"][-1]["content"]))
            answer = {"is_credentials": 1, "status": "REAL", "confidence": 0.9, "reasoning": "assigned", "evidence": ["near key"], "agent_trace": {}}
            data = json.dumps({"message": {"content": json.dumps(answer)}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out, url = lambda name: str(tmp_path / name), f"http://127.0.0.1:{server.server_address[1]}/chat"
    try:
        row = {"file_path": "a", "owner": "o", "source": "s", "pattern_name": "P", "matched_value": "Kx82!pQzz", "context": "c"}
        (tmp_path / "d.json").write_text(json.dumps([row] * 30 + [row | {"matched_value": "aaaa"}]))
        cli.main(["triage", "--input", out("d.json"), "--output", out("t"), "--endpoint", url, "--model", "m", "--at-once", "3"])
        owners = spark.read.json(out("t") + "/owners").first()
        assert (owners.total, owners.real, owners.false_positive) == (31, 30, 1) and len(asked) == 1 and asked[0][0] == "m"
        (tmp_path / "src").mkdir()
        (tmp_path / "src" / "tp.txt").write_text("dataset = [('key=abcDEF123!', None, 'abcDEF123!'), ('k2=abcDEF124!', None, 'abcDEF124!')]")
        (tmp_path / "src" / "fp.txt").write_text("dataset = [('policy text', None, None)]")
        cli.main(["build", "--source-tp", out("src/tp.txt"), "--source-fp", out("src/fp.txt"), "--out-dir", out("b"), "--augment-fp", "0"])
        cli.main(["benchmark", "--test", out("b") + "/merged_records", "--output", out("m"), "--strategies", "direct_json", "self_consistency", "--endpoint", url, "--limit", "2"])
        rows = spark.read.json(out("m") + "/rows").collect()
        assert len(rows) == 4 and all(r.latency_ms > 0 for r in rows)
        cli.main(["distill", "--input", out("b") + "/train", "--output", out("r"), "--endpoint", url, "--teacher", "big"])
        assert {r.reasoning for r in spark.read.json(out("r")).collect()} == {"assigned"}
    finally:
        server.shutdown()
