"""The reviewer: requests, calls that fail, and the ledger, against a server on this machine."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lumaflow.plans import reviewer
from lumaflow.sources import files

QUICK = reviewer.Calls(at_once=3, tries=3, wait=0.01, chunk=4)


@pytest.fixture()
def server():
    """Answers with the request's number; what ``plan`` has for it comes first, one at each call."""
    state = {"calls": Counter(), "plan": {}, "running": 0, "most": 0, "bodies": [], "lock": threading.Lock()}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with state["lock"]:
                state["running"] += 1
                state["most"] = max(state["most"], state["running"])
                k = body["messages"][1]["content"]
                n = state["calls"][k] = state["calls"][k] + 1
                state["bodies"].append((self.headers["Authorization"], body))
            plan = state["plan"].get(k, [])
            code, text = plan[n - 1] if n <= len(plan) else (200, json.dumps({"verdict": "keep", "of": k}))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}]}).encode() if code == 200 else text.encode())
            with state["lock"]:
                state["running"] -= 1

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    state["client"] = reviewer.Endpoint(f"http://127.0.0.1:{s.server_port}/v1/chat/completions", "secret", 5.0)
    yield state
    s.shutdown()


def asked(spark, names):
    rows = [(n, json.dumps({"model": "m", "messages": [{"role": "system", "content": ""}, {"role": "user", "content": n}]})) for n in names]
    return spark.createDataFrame(rows, "video_id string, request string").withColumn("request_id", F.sha2("request", 256))


def test_each_row_is_answered_once(spark, server, tmp_path):
    names = [f"v{k}" for k in range(30)] + ["v1", "v1"]
    server["plan"] = {"v3": [(503, "busy"), (429, "slow down")], "v4": [(500, "")] * 3, "v5": [(400, "bad request")], "v6": [(200, "  ")], "v7": [(200, "```json\n{\"verdict\": \"drop\"}\n```")], "v8": [(200, "no json")]}
    ledger = str(tmp_path / "ledger")
    rows = reviewer.results(reviewer.ask(asked(spark, names), server["client"], ledger, QUICK)).collect()
    by = {r["video_id"]: r for r in rows}
    assert len(rows) == 32 and server["calls"]["v1"] == 1 and {r["content"] for r in rows if r["video_id"] == "v1"} == {by["v1"]["content"]}
    assert (by["v3"]["status"], by["v3"]["attempts"], server["calls"]["v3"]) == ("answered", 3, 3)
    assert (by["v4"]["status"], by["v4"]["attempts"], by["v4"]["result"]) == ("failed", 3, None) and "HTTP 500" in by["v4"]["error"]
    assert (by["v5"]["status"], server["calls"]["v5"]) == ("refused", 1) and by["v6"]["status"] == "refused"
    assert by["v7"]["result"]["verdict"] == "drop" and by["v8"]["result"] == {"verdict": "uncertain", "parse_error": "true"} and by["v9"]["result"]["of"] == "v9"
    # a second run asks for what has no answer, and for nothing else
    before = Counter(server["calls"])
    again = reviewer.ask(asked(spark, [*names, "new"]), server["client"], ledger, QUICK).collect()
    assert server["calls"] - before == Counter({"v4": 1, "v5": 1, "v6": 1, "new": 1})
    assert all(r["status"] == "answered" for r in again) and len(again) == 33
    assert server["bodies"][0][0] == "Bearer secret"


def test_calls_at_once_are_bounded(spark, server, tmp_path):
    reviewer.ask(asked(spark, [f"w{k}" for k in range(24)]).coalesce(1), server["client"], str(tmp_path / "ledger"), reviewer.Calls(at_once=2, chunk=50)).collect()
    assert server["most"] <= 2 * 4 and sum(server["calls"].values()) == 24


def test_a_lost_job_keeps_its_answers(spark, server, tmp_path):
    """The client breaks down at one row; the rows of finished chunks aren't asked again."""
    ledger, names = str(tmp_path / "ledger"), [f"x{k:02d}" for k in range(40)]
    endpoint = server["client"]

    def breaks(request):
        if '"x07"' in request:
            raise MemoryError("gone")
        return endpoint(request)

    with pytest.raises(Exception, match="gone"):
        reviewer.ask(asked(spark, names), breaks, ledger, QUICK)
    kept = {r["request_id"] for r in reviewer.answered(spark, ledger).collect()}
    before = sum(server["calls"].values())
    rows = reviewer.ask(asked(spark, names), endpoint, ledger, QUICK).collect()
    assert kept and all(r["status"] == "answered" for r in rows) and sum(server["calls"].values()) - before == 40 - len(kept)


def test_no_server(spark, tmp_path):
    rows = reviewer.ask(asked(spark, ["a"]), reviewer.Endpoint("http://127.0.0.1:9", "k", 1.0), str(tmp_path / "l"), QUICK).collect()
    assert rows[0]["status"] == "failed" and "no answer" in rows[0]["error"]
    assert reviewer.ask(asked(spark, ["a"]), reviewer.Endpoint("", "k"), str(tmp_path / "m"), QUICK).first()["status"] == "refused"
    assert reviewer.ask(asked(spark, ["a"]).limit(0), reviewer.Endpoint("", "k"), str(tmp_path / "n"), QUICK).collect() == []


def test_requests(spark, tmp_path):
    files.commit(spark.createDataFrame([("prompts/a.md", "Rate \"it\"\n第一".encode()), ("prompts/b.md", b"B")], "path string, content binary"), str(tmp_path / "p"))
    prompts = reviewer.prompts(spark, str(tmp_path / "p"))
    assert {r["prompt_ref"] for r in prompts.collect()} == {"prompts/a.md", "prompts/b.md"}
    signals = spark.createDataFrame([(1, 0.5, None), (2, 0.25, -3.0)], "video_id long, mean double, db double")
    candidates = spark.createDataFrame([(1, s, x, 9) for s, x in ((0.0, 0.3), (3.0, 0.9), (6.0, 0.9), (9.0, 0.1))], "video_id long, start_seconds double, score double, rank int")
    referrals = spark.createDataFrame([(1, "p", "prompts/a.md", 3), (1, "q", "prompts/b.md", 1), (2, "p", "prompts/a.md", 3)], "video_id long, profile_id string, prompt_ref string, max_windows int")
    images = spark.createDataFrame([(1, ["data:image/jpeg;base64,AA=="])], "video_id long, urls array<string>")
    rows = {(r["video_id"], r["profile_id"]): json.loads(r["request"]) for r in reviewer.requests(referrals, signals, candidates, prompts, "m-1", images).collect()}
    one = rows[1, "p"]
    assert (one["model"], one["temperature"], one["response_format"]) == ("m-1", 0, {"type": "json_object"}) and [m["role"] for m in one["messages"]] == ["system", "user"]
    text, image = one["messages"][1]["content"]
    assert image == {"type": "image_url", "image_url": {"url": "data:image/jpeg;base64,AA=="}} and set(text) == {"type", "text"}
    prompt, _, told = text["text"].partition("\n\nINPUT:\n")
    told = json.loads(told)
    assert prompt == "Rate \"it\"\n第一" and told["signals"] == {"mean": 0.5, "db": None}
    assert [c["start_seconds"] for c in told["candidates"]] == [3.0, 6.0, 0.0] and told["instruction"]
    assert len(json.loads(rows[1, "q"]["messages"][1]["content"][0]["text"].split("INPUT:\n")[1])["candidates"]) == 1
    assert rows[2, "p"]["messages"][1]["content"][0]["text"].endswith('"candidates":[],"instruction":"%s"}' % reviewer.INSTRUCTION)
    for wrong in (referrals.withColumn("prompt_ref", F.lit("prompts/none.md")), referrals.withColumn("video_id", F.lit(7).cast("long"))):
        with pytest.raises(Exception, match="no prompt|without signals"):
            reviewer.requests(wrong, signals, candidates, prompts, "m").collect()
