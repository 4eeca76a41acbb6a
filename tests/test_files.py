"""Scans with their policies, sinks, the runner, the command line and the stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomworks import cli
from loomworks.config import SAMPLING, Config, backend_of, call_settings, chat_settings, client_settings, filter_chain, merged, sampling
from loomworks.operators import chatml, dedup, ranking, ratings
from loomworks.plans import runner, stages
from loomworks.sources import jsonl
from loomworks.sources.backends import Calls, HttpBackend, Pace, Sampling, StubBackend, base_url, cut, generate, logprobs, one_per_choice, retried, shares, streamed
from loomworks.streaming.incremental import dedup_stream


def lines(path):
    return [json.loads(x) for p in sorted(Path(path).glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def problems(tmp_path):
    at = tmp_path / "p.jsonl"
    rows = ['{"problem_description": "A é"}', "", "   ", "{bad", '{"other": 1}', '{"problem_description": null, "source": "FIM"}', '{"problem_description": "B"}']
    at.write_text("\n".join(rows), encoding="utf-8")
    return str(at)


def test_policies(spark, problems, tmp_path):
    rows = jsonl.read_problems(spark, problems).orderBy(*jsonl.ORDER).collect()
    assert [(r.problem_text, r.source) for r in rows] == [("A é", "UNKNOWN"), (None, "FIM"), ("B", "UNKNOWN")]
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, problems, "problem_description string").collect()
    assert jsonl.read_problems(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.read_keys(spark, str(tmp_path / "none")).count() == 0


def test_samples_and_round_trip(spark, tmp_path):
    at = tmp_path / "s.jsonl"
    at.write_text('{"prompt": "", "docstring": "d", "solution": "s", "k": 1}\n{"prompt": "p", "code": "c"}\n')
    rows = jsonl.read_samples(spark, str(at)).orderBy(*jsonl.ORDER)
    assert [tuple(r)[:3] for r in rows.collect()] == [("d", "s", {"k": "1"}), ("p", "c", None)]
    jsonl.write_jsonl(rows, str(tmp_path / "out"))
    assert lines(tmp_path / "out") == [{"prompt": "d", "code": "s", "meta": {"k": "1"}}, {"prompt": "p", "code": "c", "meta": None}]


def test_order_survives_repartition(spark):
    rows = spark.range(200).select("id", (F.col("id") % 17).cast("string").alias("t"))
    first = {tuple(r) for r in dedup.new_rows(rows, None, "t", "id").collect()}
    assert first == {tuple(r) for r in dedup.new_rows(rows.repartition(7, "t"), None, "t", "id").collect()}
    assert {r[0] for r in first} == set(range(17))


@pytest.mark.parametrize("n,kept", [(0, 0), (1, 1), (3, 1), (10, 5)])
def test_keep_ratio(spark, n, kept):
    assert ranking.keep_best(spark.range(n).withColumn("ppl", F.lit(None).cast("double")), 0.5, "id").count() == kept


def test_expand_none(spark):
    assert ranking.expand_candidates(spark.range(3), 0).count() == 0


def test_candidate_pipeline(spark, tmp_path):
    at = tmp_path / "in.jsonl"
    at.write_text('{"prompt": "a"}\n{"description": "b"}\n')
    paths = [str(tmp_path / x) for x in ("cand", "scored", "best")]
    cli.main(["generate", str(at), paths[0], "--n", "2"], spark)
    cli.main(["score", paths[0], paths[1]], spark)
    cli.main(["filter", paths[1], paths[2]], spark)
    assert [(r["prompt"], r["code"][:14]) for r in lines(paths[0])] == [("a", "def auto_gen_0"), ("a", "def auto_gen_1"), ("b", "def auto_gen_0"), ("b", "def auto_gen_1")]
    best = lines(paths[2])
    assert len(best) == 2 and all(r["ppl"] > 0 for r in best)


def answer(prompt, attempt):
    if "Rate the code" in prompt:
        return "".join(f"{t} Score: {4 + (attempt > 1)}\n" for t in ("Problem Design", "Function Definition", "Correctness", "Efficiency", "Readability")) + "Summary: good"
    if "Write the body" in prompt:
        return "return 1"
    if "signature" in prompt:
        return "def f_" + str(len(prompt) % 3) + '(x):\n    """D."""'
    return f"Title {attempt}\nHint: none"


def test_runner_end_to_end_and_resume(spark, tmp_path):
    run = runner.Runner(spark, str(tmp_path / "data"), lambda sampled: StubBackend(answer, sampled.stop))
    assert run.full("FIM", 4) == {"problems": {"kept": 1, "duplicate": 3}, "skeletons": {"kept": 1}, "code": {"kept": 1}}
    assert run.ratings("FIM") == {"kept": 1}
    assert run.ratings("FIM") == {}  # rated before
    assert run.problems("FIM", 2) == {"duplicate": 2}
    stats = run.convert("FIM")
    assert (stats["total"], stats["converted"], stats["success_rate"]) == (1, 1, 100.0)
    (record,) = lines(run.path("FIM", "chatml"))
    assert [m["role"] for m in record["messages"]] == ["user", "assistant"] and record["messages"][1]["content"] == "return 1"
    assert record["messages"][0]["content"].startswith("Title 1\n\ndef f_")
    report = run.analyze(str(tmp_path / "report"))
    assert "FIM Total Samples: 1\nL2R Total Samples: 0" in report and "Difference (L2R - FIM): -4.000" in report


def test_report_layout():
    stats = {(m, d): {"mean": 4.0, "median": 4.0, "std": 0.5, "count": 3} for m in ratings.MODES for d in ratings.TITLES}
    text = ratings.report(stats).split("\n")
    assert text[:8] == ["=" * 80, "CODE QUALITY RATING STATISTICS REPORT", "=" * 80, "", "## Overall Summary", "", "FIM Total Samples: 3", "L2R Total Samples: 3"]
    assert text[13:21] == ["### Problem Design Quality", "", "FIM:", "  Mean:   4.000", "  Median: 4.000", "  Std:    0.500", "  Count:  3", ""]
    assert text[-1] == "=" * 80 and len(text) == 112


def test_statistics_of_known_scores(spark):
    rows = spark.createDataFrame([("FIM", "correctness", float(x)) for x in (4, 5, 5, 3)], "mode string, dimension string, score double")
    stats = ratings.collected(ratings.statistics(rows))
    got = stats["FIM", "correctness"]
    assert (got["mean"], got["median"], round(got["std"], 6), got["count"]) == (4.25, 4.5, 0.829156, 4)
    assert stats["L2R", "efficiency"]["count"] == 0 and len(stats) == 10


def test_backends(spark):
    waits = []

    def fails():
        raise OSError("no")

    with pytest.raises(OSError):
        retried(fails, 3, waits.append)
    assert waits == [1.1, 2.2]
    assert (base_url("http://h/"), base_url("http://h/v1/")) == ("http://h/v1", "http://h/v1")
    assert cut("a---b", ["---", "x"]) == "a"

    class Broken:
        def complete(self, prompt, attempt):
            raise ValueError(prompt)

    rows = generate(spark.createDataFrame([("p",)], "prompt string"), Broken, calls=Calls(retries=1)).collect()
    assert rows[0].response is None and rows[0].error == "ValueError: p"
    assert len(logprobs(spark.createDataFrame([("abc",)], "code string"), StubBackend).first().logprobs) == 3


def test_config(tmp_path):
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    (tmp_path / "a.yaml").write_text("api: {base_url: u, concurrency: {max_concurrent_requests: 7}}")
    (tmp_path / "b.yaml").write_text("")
    config = Config.from_files(tmp_path / "a.yaml", None, tmp_path / "b.yaml")
    config.set("x.y", 1)
    assert config.get("x.y") == 1 and config.get("x.z", 2) == 2
    assert client_settings(config)["max_concurrent"] == 7 and client_settings(config)["timeout_s"] == 60


def test_stream_appends_new_rows_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": "a"}\n')
    args = (spark, str(source), "id long, t string", target, str(tmp_path / "ck"), "t", ("id",))
    dedup_stream(*args).awaitTermination(120)
    (source / "2.json").write_text('{"id": 3, "t": "a"}\n{"id": 4, "t": "b"}\n')
    dedup_stream(*args).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 4]


class Server:
    """Keeps each request's route and body, and answers like the common completions API."""

    def __init__(self, reply):
        import threading
        from http.server import BaseHTTPRequestHandler, HTTPServer

        asked = self.asked = []

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                asked.append((self.path, body))
                data = reply(body)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_stage_parameters_reach_the_request(spark, tmp_path):
    def reply(body):
        text = answer(body["prompt"], 1)
        return json.dumps({"choices": [{"index": 0, "text": text}]}).encode()

    server = Server(reply)
    config = Config({"api": {"base_url": server.url, "concurrency": {"max_concurrent_requests": 2}}, "models": {"default": "m"}, "rating": {"temperature": 0.1, "stop": ["###"]}, "namegen": {"num_samples": 2}})
    run = runner.Runner(spark, str(tmp_path / "d"), backend_of(config), config)
    assert run.full("L2R") == {"problems": {"kept": 1, "duplicate": 1}, "skeletons": {"kept": 1}, "code": {"kept": 1}}
    assert run.ratings("L2R") == {"kept": 1}
    sent = {}
    for route, body in server.asked:
        assert route == "/v1/completions" and body["model"] == "m" and body["n"] == 1 and body["stream"] is False
        kind = next((k for k, mark in (("ratings", "Rate the code"), ("code", "Write the body"), ("skeletons", "signature")) if mark in body["prompt"]), "problems")
        sent[kind] = (body["temperature"], body["top_p"], body["max_tokens"], body.get("stop"))
    assert sent == {"problems": (1.0, 0.95, 2048, ["---"]), "skeletons": (0.7, 0.95, 512, None), "code": (0.7, 0.95, 1024, ["\n\ndef ", "\n\nclass "]), "ratings": (0.1, 0.9, 1024, ["###"])}


def test_request_forms():
    pieces = [{"choices": [{"index": 1, "text": "b"}]}, {"choices": [{"index": 0, "text": "a"}, {"index": 1, "text": "c"}]}]
    stream = b"".join(b"data: " + json.dumps(p).encode() + b"\n\n" for p in pieces) + b"data: [DONE]\n\n"
    server = Server(lambda body: stream if body["stream"] else json.dumps({"choices": [{"message": {"content": "x"}}] if "messages" in body else [{"text": "t", "logprobs": {"token_logprobs": [None, -1.0]}}]}).encode())
    assert streamed(stream.splitlines(), 2) == [{"text": "a"}, {"text": "bc"}]
    assert HttpBackend(server.url, "m", Sampling(n=2, stream=True)).choices("p") == ["a", "bc"]
    assert HttpBackend(server.url, "m", Sampling(logprobs=1, extra=(("seed", 7),))).complete("p", 1) == "t"
    assert (server.asked[-1][1]["logprobs"], server.asked[-1][1]["seed"]) == (1, 7)
    assert HttpBackend(server.url, "m").choices("a", "z") == ["t"] and server.asked[-1][1]["suffix"] == "z"
    chat = HttpBackend(server.url, "m", chat_for_fim=True, prefix_key="before", suffix_key="after")
    assert chat.choices("a", "z") == ["x"]
    route, body = server.asked[-1]
    assert route == "/v1/chat/completions" and (body["before"], body["after"]) == ("a", "z")
    assert HttpBackend(server.url, "m").token_logprobs("t") == [None, -1.0]


def test_pairs_and_choices(spark):
    class Two:
        def choices(self, prompt, suffix, attempt):
            return [f"{prompt}1{suffix}", f"{prompt}2{suffix}"]

    pairs = spark.createDataFrame([("a", "z"), ("b", "y")], "prompt string, suffix string")
    assert sorted(r.response for r in generate(pairs, Two, suffix="suffix").collect()) == ["a1z", "b1y"]
    every = one_per_choice(generate(pairs, Two, suffix="suffix", choices=True))
    assert sorted((r.prompt, r.choice, r.response) for r in every.collect()) == [("a", 0, "a1z"), ("a", 1, "a2z"), ("b", 0, "b1y"), ("b", 1, "b2y")]


def test_limits_of_a_job():
    assert shares(1000, Calls(concurrent=256, flush=50), 8) == (20, 32, None)
    assert shares(1000, Calls(concurrent=3, flush=50, per_second=6.0), 8) == (3, 1, 2.0)
    assert shares(10**9, Calls(flush=50), 8)[0] == 10_000 and shares(0, Calls(), 8)[0] == 1
    waits, clock = [], [0.0]
    pace = Pace(2.0, lambda: clock[0], waits.append)
    for _ in range(3):
        pace()
    assert waits == [0.0, 0.5, 1.0]


def test_a_killed_run_resumes_with_its_finished_rows(spark, tmp_path):
    """The worker of one row dies; the others' answers stay and are not asked for again."""
    notes, bomb = tmp_path / "asked", tmp_path / "bomb"
    notes.mkdir()
    bomb.write_text("")

    class Fragile:
        def complete(self, prompt, attempt):
            import os
            import time

            number = prompt.split("#")[1].split("#")[0]
            (notes / f"{number}-{time.time_ns()}").write_text("")
            if number == "7" and bomb.exists():
                time.sleep(3)
                os._exit(1)
            return f"def f_{number}(x):\n    pass"

    target = tmp_path / "data" / "fim"
    target.mkdir(parents=True)
    (target / "problems.jsonl").write_text("".join(json.dumps({"problem_description": f"#{i}#"}) + "\n" for i in range(8)))
    config = Config({"skeleton": {"batch_write_size": 1}})
    run = runner.Runner(spark, str(tmp_path / "data"), lambda sampled: Fragile(), config, Calls(concurrent=4))
    with pytest.raises(Exception):
        run.skeletons("FIM")
    assert not (target / "skeletons.jsonl").exists()
    first = {p.name.split("-")[0] for p in notes.iterdir()}
    bomb.unlink()
    assert run.skeletons("FIM") == {"kept": 8}
    asked = [p.name.split("-")[0] for p in notes.iterdir()]
    assert "7" in first and len(asked) < 8 + len(first) and {r["function_name"] for r in lines(target / "skeletons.jsonl")} == {f"f_{i}" for i in range(8)}
    assert not (target / "skeletons.jsonl.answers").exists()


def test_calls_after_a_limit_run_in_many_tasks(spark):
    import os

    class Where:
        def complete(self, prompt, attempt):
            from pyspark import TaskContext

            return str(TaskContext.get().partitionId()) if TaskContext.get() else str(os.getpid())

    rows = dedup.first_rows(spark.range(1000).select("id", F.col("id").cast("string").alias("prompt")), 200, "id")
    got = generate(rows, Where, calls=Calls(flush=25, concurrent=8)).collect()
    assert {r.id for r in got} == set(range(200)) and len({r.response for r in got}) > 1


def test_ranked_cut_is_not_one_task(spark):
    rows = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("ppl"))
    best = ranking.keep_best(rows, 0.5, "id")
    want = sorted(((1e9 if i % 3 == 0 else i % 5), i) for i in range(4000))[:2000]
    assert {r.id for r in best.collect()} == {i for _, i in want}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("TakeOrdered", "Limit", "Exchange", "Sort")) and best.rdd.getNumPartitions() == 8


def test_cuts_among_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1.0, None), (1.0, "x"), (1.0, "x"), (1.0, "x"), (2.0, "z")], "v double, t string").repartition(3)
    for n in range(9):
        got = sorted(((r.v is not None, r.v or 0.0), (r.t is not None, r.t or "")) for r in ranking.first_of(rows, n, "v", "t").collect())
        every = sorted(((r.v is not None, r.v or 0.0), (r.t is not None, r.t or "")) for r in rows.collect())
        assert got == every[:n]
    assert ranking.first_of(rows, 3, F.coalesce("v", F.lit(9.0))).count() == 3


def test_an_answer_that_most_rows_have(spark):
    """One uid for most rows: the first is kept, the others are duplicates, and no window sorts them in one task."""
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("same").alias("t"), F.lit(None).cast("string").alias("error"))
    done = stages._finish(rows, F.when(F.col("t") == "10", "empty"), "t", ("id",), None)
    got = {r.id: r.status for r in done.collect()}
    assert got == {i: "empty" if i == 10 else "kept" if i % 10 == 0 or i == 1 else "duplicate" for i in range(2000)}
    assert "Window" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_settings_are_used():
    config = Config({"filter": {"min_ratings": {"correctness": 5}, "require_all_above_threshold": False}, "output": {"fields": ["uid"]}, "filters": {"name_regex": "x+", "min_code_len": 3}, "namegen": {"weaklist": ["XX"], "temperature": 0.5}, "api": {"max_retries": 7, "concurrency": {"rate_limit_per_second": 4}}})
    assert chat_settings(config) == {"thresholds": {"correctness": 5}, "require_all": False, "fields": ("uid",)} and chat_settings(Config()) == {}
    assert (call_settings(config).retries, call_settings(config).per_second, call_settings(config).concurrent) == (7, 4, 10)
    assert sampling(config, "problems") == Sampling(0.5, 0.95, 2048, ("---",)) and sampling(Config(), "ratings") == SAMPLING["ratings"]


def test_configured_chains(spark):
    config = Config({"filters": {"name_regex": "x+", "min_code_len": 3}, "namegen": {"weaklist": ["XX"]}})
    names = spark.createDataFrame([("xxx",), ("xx",), ("yy",)], "n string")
    assert [r.n for r in filter_chain(config, "names").apply(names, "n").collect()] == ["xxx"]
    assert [r.n for r in filter_chain(config, "code").apply(names, "n").collect()] == ["xxx"]


def test_one_record(spark):
    """The driver's single-record conversion agrees with the table's."""
    codes = ['def f(a):\n    """D."""\n    return a', "x = 1", "def f(a): return a", None]
    texts = ["T\n  Hint: h\nmore", "Hint: h", " no Hint: here ", None]
    scores = [dict.fromkeys(chatml.THRESHOLDS, 5), dict.fromkeys(chatml.THRESHOLDS, 5) | {"efficiency": 2}, {"correctness": None}]
    data = [(f"{i}{j}{k}", t, c, s) for i, t in enumerate(texts) for j, c in enumerate(codes) for k, s in enumerate(scores)]
    kind = "uid string, problem_text string, code string, ratings struct<" + ",".join(f"{d}:int" for d in chatml.THRESHOLDS) + ">"
    rows = spark.createDataFrame([(u, t, c, tuple(s.get(d) for d in chatml.THRESHOLDS)) for u, t, c, s in data], kind)
    want = {r.uid: [m.asDict() for m in r.messages] for r in chatml.chat_records(rows).collect()}
    got = {u: r["messages"] for u, t, c, s in data if (r := chatml.chat_record({"uid": u, "problem_text": t, "code": c, "ratings": s}))}
    assert got == want and len(got) == 4


def test_log_files(spark, tmp_path):
    import logging

    cli.main(["--log-dir", str(tmp_path / "logs"), "--base", str(tmp_path / "d"), "problems", "--num-samples", "1"], spark)
    (log,) = (tmp_path / "logs" / "problems").glob("*.log")
    assert "problems" in log.read_text()
    logging.basicConfig(force=True, handlers=[logging.NullHandler()])
