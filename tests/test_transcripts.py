import random

import pytest
from pyspark.sql import functions as F

from loomstat.operators import aggregation, chunking, flatten, scoring, transcripts
from loomstat.queries import QUERIES


def sequential_flatten(rows):
    """The order of things, one after the other."""
    samples = sorted({r["si"] for r in rows})
    seen, loose, pending, kept = set(), 0, {}, []
    anchors = {}
    sig = lambda r: (r["role"] or "", r["content"] or "", r["call"] or "", r["arguments"] or "")
    inputs = [r for s in samples for r in sorted((x for x in rows if x["si"] == s and x["tier"] == 0), key=lambda x: x["i"])]
    keys = {}
    best = None
    for r in inputs:
        if r["node_id"] is None:
            loose += 1
            key = (0 if best is None else max(best, 0)) + loose
            best = key if best is None else max(best, key)
        else:
            key = r["node_id"]
            best = key if best is None else max(best, key)
        keys[id(r)] = key
        anchors[r["si"]] = key
    events = [r for s in samples for t in (0, 1) for r in sorted((x for x in rows if x["si"] == s and x["tier"] == t), key=lambda x: x["i"])]
    for r in events:
        if r["tier"] == 1:
            pending[sig(r)] = pending.get(sig(r), 0) + 1
            kept.append((anchors.get(r["si"], loose), 1, r["i"], r["si"], r["i"], r))
            continue
        if r["node_id"] is not None:
            if r["node_id"] in seen:
                continue
            seen.add(r["node_id"])
        if pending.get(sig(r), 0) > 0:
            pending[sig(r)] -= 1
            continue
        kept.append((keys[id(r)], 0, 0, r["si"], r["i"], r))
    return [sig(x[-1]) + (x[1],) for x in sorted(kept, key=lambda x: x[:5])]


def test_flatten_dag_is_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = []
    for run in range(60):
        node = rng.randint(0, 3)
        said = []
        for si in range(rng.randint(1, 4)):
            for i in range(rng.randint(0, 4)):
                if said and rng.random() < 0.3:
                    content = rng.choice(said)
                else:
                    content = rng.choice("abcd")
                kind = rng.random()
                node += rng.randint(1, 2)
                rows.append((run, si, 0, i, node if kind < 0.8 else rng.randint(0, node), "user", content, None, None))
            for i in range(rng.randint(0, 2)):
                content = rng.choice("wxyz")
                said.append(content)
                rows.append((run, si, 1, i, None, "user", content, None, None))
    schema = "run_id int, si int, tier int, i int, node_id long, role string, content string, call string, arguments string"
    names = [c.split()[0] for c in schema.split(", ")]
    got = flatten.flatten_dag(spark.createDataFrame(rows, schema)).toPandas()
    for run in range(60):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == run]
        want = sequential_flatten(own)
        mine = got[got.run_id == run].sort_values("pos")
        assert [(r.role, r.content, r.call, r.arguments, r.tier) for r in mine.itertuples()] == want


def test_explode_samples(spark):
    msg = "struct<role:string,content:string,function_call:struct<name:string,arguments:string>,metadata:struct<node_id:bigint>>"
    m = lambda c, n: ("user", c, ("", ""), (n,))
    rows = [(1, [([m("a", 0)], [[m("x", None)], [m("other", None)]]), ([m("a", 0), m("x", 1), m("b", 2)], [])])]
    df = spark.createDataFrame(rows, f"run_id int, samples array<struct<input:array<{msg}>,output:array<array<{msg}>>>>")
    flat = flatten.flatten_dag(flatten.explode_samples(df)).orderBy("pos").collect()
    assert [r.content for r in flat] == ["a", "x", "b"]
    long = flatten.explode_samples(df)
    assert [r.content for r in flatten.flatten_longest(long).orderBy("pos").collect()] == ["a", "x", "b"]
    assert [r.content for r in flatten.flatten_concat(long).orderBy("pos").collect()] == ["a", "x"]


@pytest.mark.parametrize(
    ("n", "size", "overlap", "want"),
    [(25, 10, 0, [(0, 10), (10, 20), (20, 25)]), (20, 10, 4, [(0, 10), (6, 16), (12, 20)]), (20, 10, 0, [(0, 10), (10, 20)]), (3, 10, 0, [(0, 3)]), (0, 10, 0, [])],
)
def test_windows(spark, n, size, overlap, want):
    df = spark.createDataFrame([(1, n)], "run_id int, n_messages int")
    got = chunking.windows(df, size, overlap).orderBy("chunk_index").collect()
    assert [(r.start_message, r.end_message) for r in got] == want
    told = spark.range(n).select(F.lit(1).alias("run_id"), F.col("id").cast("int").alias("pos"))
    rows = chunking.chunk_messages(told, size, overlap).toPandas()
    for k, (a, b) in enumerate(want):
        assert sorted(rows[rows.chunk_index == k].pos) == list(range(a, b))
    assert len(rows) == sum(b - a for a, b in want)


@pytest.mark.parametrize("overlap", [0, 30, 500])
def test_character_windows(spark, overlap):
    rng = random.Random(1)
    sizes = {r: [rng.choice([0, 5, 40, 90, 300]) for _ in range(rng.randint(1, 12))] for r in range(40)}
    rows = [(r, p, "x" * n) for r, s in sizes.items() for p, n in enumerate(s)]
    got = chunking.character_windows(spark.createDataFrame(rows, "run_id int, pos int, content string"), 250, overlap).toPandas()
    for r, s in sizes.items():
        want, start = [], 0
        while True:
            end, total = start, 0
            while end < len(s) and (end == start or total + s[end] <= 250):
                total += s[end]
                end += 1
            want.append((start, end))
            if end == len(s):
                break
            back, new = 0, end
            while overlap and new > start + 1 and back + s[new - 1] <= overlap:
                new -= 1
                back += s[new]
            start = new
        mine = got[got.run_id == r].sort_values("chunk_index")
        assert list(zip(mine.start_message, mine.end_message, strict=True)) == want


def test_header_and_echo(spark):
    prompt = "You must follow these rules exactly. " * 5
    log = "log: " + prompt.replace(" ", "\\n") + "y" * 80
    rows = [
        (1, 0, "system", prompt), (1, 1, "user", "the task"),
        (1, 2, "function", f"before\n{log}\nafter" ), (1, 3, "assistant", "You must follow these rules exactly."),
        (2, 0, "user", "You are an autonomous AI agent. Go."), (2, 1, "user", "x"), (3, 0, "user", "hello"), (3, 1, "system", "later"),
    ]
    df = spark.createDataFrame(rows, "run_id int, pos int, role string, content string").withColumns({"node_id": F.col("pos"), "name": F.lit(None).cast("string"), "function_call": F.lit(None).cast("struct<name:string,arguments:string>")})
    got = {(r.run_id, r.pos): r.content for r in transcripts.redact_echoes(df).collect()}
    assert got == {
        (1, 0): "the task", (1, 1): "before\n[redacted]\nafter", (1, 2): "You must follow these rules exactly.",
        (2, 0): "x", (3, 0): "hello", (3, 1): "later",
    }


def test_positions_across_blocks(spark):
    ids = [0, 1, 5, 4095, 4096, 4097, 9000, 123456]
    df = spark.createDataFrame([(g, x) for g in (1, 2) for x in ids], "g int, k long")
    got = transcripts.positions(df, "g", "k").orderBy("g", "k").collect()
    assert [r.pos for r in got] == list(range(len(ids))) * 2


def test_folds(spark):
    rows = [(1, 0, 5.0), (1, 1, 90.0), (1, 2, 10.0), (2, 0, 90.0), (2, 1, None), (3, 0, None), (4, 0, 10.0), (4, 1, 20.0), (5, 0, 50.0), (5, 1, 50.0)]
    df = spark.createDataFrame(rows, "run_id int, chunk_index int, score double")
    got = df.groupBy("run_id").agg(
        *(aggregation.fold(m, k=99).alias(m) for m in aggregation.METHODS), aggregation.evidence("max").alias("top"), aggregation.evidence("mean").alias("none")
    ).orderBy("run_id").collect()
    assert [r["max"] for r in got] == [90, 90, None, 20, 50]
    assert [r["mean"] for r in got] == [35, 90, None, 15, 50]
    assert got[3]["topk_mean"] == 15 and got[4]["noisy_or"] == pytest.approx(75)
    assert [r.top for r in got] == [1, 0, None, 1, 0] and {r.none for r in got} == {None}


def test_run_results(spark):
    rows = [(1, 0, 70.0, 0, 10, "why"), (2, 0, None, 0, 3, None)]
    chunks = spark.createDataFrame(rows, "run_id long, chunk_index int, score double, start_message int, end_message int, reasoning string")
    got = {r.run_id: r for r in aggregation.run_results(spark.range(1, 4).withColumnRenamed("id", "run_id"), chunks).collect()}
    assert got[1].reasoning == "[chunk 0, messages 0-9] why" and got[2].error == "AllChunksFailed: 1/1" and got[3].error == "EmptyTranscript"


def test_batch_scorer(spark):
    def judge(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError
        return [{"score": len(p) if p != "odd" else 120, "reasoning": p} for p in prompts]

    df = spark.createDataFrame([(1, "abc"), (2, "odd"), (3, "x" * 50)], "run_id int, prompt string").coalesce(1)
    got = {r.run_id: (r.score, r.error) for r in scoring.batch_scorer(judge, 20)(df).collect()}
    assert got == {1: (3.0, None), 2: (None, "InvalidVerdictError"), 3: (None, "TranscriptTooLargeError")}
    bad = spark.createDataFrame([(1, "boom")], "run_id int, prompt string")
    assert scoring.batch_scorer(judge, 20)(bad).first().error == "UpstreamError: RuntimeError"
    mixed = spark.createDataFrame([(1, "boom"), (2, "abc")], "run_id int, prompt string").coalesce(1)
    assert {r.run_id: r.score for r in scoring.batch_scorer(judge, 20)(mixed).collect()} == {1: None, 2: 3.0}


def test_cache_scores_each_call_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def judge(prompts):
        calls.add(len(prompts))
        return [{"score": 1, "reasoning": ""} for _ in prompts]

    told = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "run_id int, prompt string").withColumn("key", scoring.cache_key("m", "s", F.col("prompt")))
    old = told.where("run_id = 4").select("key", F.lit(9.0).alias("score"), F.lit("old").alias("reasoning"))
    scored, _ = scoring.cached(told.select("run_id", "key", "prompt"), old, scoring.batch_scorer(judge, 99))
    rows = {r.run_id: r.score for r in scored.collect()}
    assert rows == {1: 1.0, 2: 1.0, 3: 1.0, 4: 9.0} and calls.value == 2


def test_whole_prompts_refuse_by_the_limit_only(spark):
    rows = [(1, 0, "user", None, "a" * 30_000, None), (2, 0, "user", None, "short", None), (2, 1, "assistant", None, "too", None)]
    schema = "run_id long, pos int, role string, name string, content string, function_call struct<name:string,arguments:string>"
    told = spark.createDataFrame(rows, schema)
    small, large = ({r.run_id: r for r in chunking.whole_prompts(told, most).collect()} for most in (20_000, 1_540_000))
    assert small[1].prompt is None and small[1].error == "TranscriptTooLargeError" and small[2].error is None
    assert "a" * 30_000 in large[1].prompt and large[1].error is None and large[2].prompt == small[2].prompt


def test_whole_prompts_build_the_long_runs(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.run_id: r for r in QUERIES["whole_prompts"](spark, folder).collect()}
    long = {r.run_id for r in QUERIES["run_lengths"](spark, folder).where("n_characters > 20000").collect()}
    assert long and all(got[k].digest and got[k].error is None for k in long)


def test_answers_and_errors_of_a_model(spark):
    def call(prompt, seconds):
        assert 120 <= seconds <= 900
        if prompt == "boom":
            raise TimeoutError
        return {
            "cut": {"score": 3, "finish_reason": "length", "completion_tokens": 256}, "no": {"refusal": "I won't"}, "half": {"score": 1.5}, "none": {}, "flag": {"score": True},
        }.get(prompt, {"score": 40, "reasoning": "ok", "finish_reason": "stop", "prompt_tokens": 7})

    words = ["a", "boom", "cut", "no", "half", "none", "flag", None, "x" * 99]
    df = spark.createDataFrame(list(enumerate(words)), "run_id int, prompt string").coalesce(1)
    scored = scoring.prompt_scorer(call, 50, retries=1)(df)
    got = {r.run_id: r.error for r in scored.collect()}
    invalid = "InvalidVerdictError"
    assert got == {
        0: None, 1: "UpstreamError: TimeoutError", 2: "TruncatedResponseError", 3: "RefusalError", 4: invalid, 5: invalid, 6: invalid, 7: "EmptyTranscript", 8: "TranscriptTooLargeError"
    }
    told = scoring.usage(scored).first()
    assert (told.n_calls, told.n_failed, told.prompt_tokens, told.completion_tokens) == (9, 8, 7, 256)
    assert scoring.time_limit(0) == 120 and scoring.time_limit(10**9) == 900


def test_windows_are_the_greedy_ones():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, 9, 30]) for _ in range(rng.randint(0, 12))]
        budget, overlap = rng.choice([1, 8, 20, 60]), rng.choice([0, 3, 10])
        windows = [(w["start"], w["end"]) for w in chunking.window_spans(sizes, budget, overlap)]
        want, at = [], 0
        while at < len(sizes):
            end = max([at + 1, *(e for e in range(at + 1, len(sizes) + 1) if sum(sizes[at:e]) <= budget)])
            want.append((at, end))
            if end == len(sizes):
                break
            at = max(at + 1, min([end, *(b for b in range(at + 1, end + 1) if overlap and sum(sizes[b:end]) <= overlap)]))
        assert windows == want, (sizes, budget, overlap)


def test_text_of_transcripts(spark, tmp_path):
    from loomstat.sources import sinks

    schema = "run_id long, pos int, role string, name string, content string, function_call struct<name:string,arguments:string>"
    told = spark.createDataFrame([(1, 1, "assistant", None, "two", None), (1, 0, "user", None, "one", None), (2, 0, "user", None, "x" * 500, None)], schema)
    got = {r.run_id: r.text for r in transcripts.as_text(told, 100).collect()}
    assert got == {1: "[user]\none\n\n---\n\n[assistant]\ntwo", 2: None}
    sinks.write_text(str(tmp_path / "t.txt"), transcripts.text_parts(told, 1))
    assert (tmp_path / "t.txt").read_text() == got[1]


def test_a_line_that_was_redacted_before_changes_nothing(spark):
    head = "You are to act as an autonomous agent. " + "Do this and that with great care. " * 8
    body = "\n".join(["[redacted]", "log: " + head + " " * 3 + "end", "short"])
    schema = "run_id long, pos int, node_id long, role string, name string, content string, function_call struct<name:string,arguments:string>"
    told = spark.createDataFrame([(1, 0, 0, "system", None, head, None), (1, 1, 1, "tool", None, body, None)], schema)
    assert transcripts.redact_echoes(told).first().content == "[redacted]\n[redacted]\nshort"
