import json

import pytest
from pyspark.sql import functions as F

from loomstat.operators import explore, sampling
from loomstat.plans.config import ExperimentSettings
from loomstat.plans.experiment import analyse, compare, monitor_chunks, monitor_whole, prepared, select_runs
from loomstat.sources import files, sinks


@pytest.fixture(scope="module")
def meta(spark):
    rows = []
    for k in range(400):
        label = ["bypass_constraints"] if k < 20 else ["sabotage"] if k < 120 else ["refusals", "sabotage"] if k < 130 else ["normal"] if k % 2 else []
        rows.append((k, f"t{k % 17}", "m", label, k < 300, "prompted" if 20 <= k < 130 else "unprompted", True))
    df = spark.createDataFrame(rows, "run_id long, task_id string, model string, labels array<string>, manually_reviewed boolean, run_source string, has_chain_of_thought boolean")
    return explore.run_metadata(df.withColumns({"ingested_at": F.lit("2025-01-01").cast("timestamp"), "is_positive": F.lit(False), "n_labels": F.lit(0), "is_prompted": F.lit(False)}))


def ids(df):
    return {r.run_id for r in df.select("run_id").collect()}


def test_draws_are_the_same_for_a_seed_and_any_layout(meta):
    a, b, c = ids(sampling.uniform(meta, 50, 1)), ids(sampling.uniform(meta.repartition(7), 50, 1)), ids(sampling.uniform(meta, 50, 2))
    assert a == b and a != c and len(a) == 50
    assert len(ids(sampling.uniform(meta, 9_999))) == 400 and not ids(sampling.uniform(meta, 0))


def test_balanced_backfills(meta):
    got = sampling.balanced(meta, 100, 0.5, 0.2).collect()
    assert len(got) == 100 and sum(r.is_positive for r in got) == 50 and sum(r.is_positive and not r.is_prompted for r in got) == 20


def test_quotas_draw_a_run_once(meta):
    got = sampling.by_quota(meta, {"sabotage": "all", "refusals": 5, "benign": 10}).collect()
    assert len({r.run_id for r in got}) == len(got)
    by = {q: sum(r.quota == q for r in got) for q in ("sabotage", "refusals", "benign")}
    assert by == {"refusals": 5, "sabotage": 105, "benign": 10}


def test_select_runs(meta):
    s = ExperimentSettings.of({"subset": {"label_quotas": {"bypass_constraints": 3, "benign": 2}}})
    assert len(ids(select_runs(meta, s))) == 5
    lengths = meta.select("run_id", F.when(F.col("run_id") < 10, 999).otherwise(1).alias("n_tokens"))
    s = ExperimentSettings.of({"subset": {"n_samples": 400, "max_tokens": 500}})
    assert min(ids(select_runs(meta, s, lengths))) == 10


def test_settings_are_checked():
    for bad in ({"odd": 1}, {"chunk": {"size": 0}}, {"chunk": {"overlap": 10}}, {"aggregate": {"method": "median"}}, {"subset": {"positive_fraction": 2}}):
        with pytest.raises(ValueError):
            ExperimentSettings.of(bad)
    assert ExperimentSettings.of({"chunk": {"size": 3}}).as_dict()["chunk"]["size"] == 3


def test_jsonl(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("run_id long, score double, line_no long")
    path = tmp_path / "r.jsonl"
    path.write_text('{"run_id": 1, "score": NaN, "line_no": 1}\n\n{"run_id": 1, "score": 7, "line_no": 2}\n{"run_id": 2, "sco')
    got = files.read_jsonl(spark, str(path), schema, strict=False)
    assert [r.score for r in files.last_by_line(got, ["run_id"]).collect()] == [7.0]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(path), schema).collect()


def test_documents_csv_and_rewrite(spark, tmp_path):
    sinks.write_document(str(tmp_path / "a" / "m.json"), {"run_ids": [3, 1]})
    assert files.read_manifest(str(tmp_path / "a" / "m.json")) == {"run_ids": [3, 1]}
    assert [r.run_id for r in files.manifest_ids(spark, str(tmp_path / "a" / "m.json")).orderBy("pos").collect()] == [3, 1]
    df = spark.createDataFrame([(1, 'a "quoted"\nline', ["x", "y"])], "run_id int, t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    row = files.read_csv(spark, str(tmp_path / "c"), spark.createDataFrame([], "run_id int, t string, l string").schema).first()
    assert tuple(row) == (1, 'a "quoted"\nline', "x;y")
    path = str(tmp_path / "p")
    spark.range(10).write.parquet(path)
    sinks.rewrite(spark.read.parquet(path).where("id < 3"), path)
    assert spark.read.parquet(path).count() == 3
    sinks.append_cache(spark.createDataFrame([("abcd", 1.0)], "key string, score double"), str(tmp_path / "cache"))
    assert (tmp_path / "cache" / "shard=ab").is_dir()
    folder = sinks.RunFolder(str(tmp_path), "e", "s")
    folder.write_manifest(usage=3)
    assert json.loads((tmp_path / "e" / "s" / "run.json").read_text())["usage"] == 3


def test_ids_env_and_prompts(spark, tmp_path):
    assert files.parse_ids("3,1", allowed=[1, 2, 3]) == [1, 3]
    with pytest.raises(ValueError):
        files.parse_ids("9", allowed=[1])
    (tmp_path / ".env").write_text("# x\nexport A='1'\nB=2\n")
    env = {"B": "old"}
    assert files.load_env(str(tmp_path / ".env"), env=env) == {"A": "1"} and env == {"A": "1", "B": "old"}
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "p.md").write_text("hi")
    assert files.load_prompt(str(tmp_path), "v1", "p")[0] == "hi" and files.available_prompts(str(tmp_path)) == ["v1"]
    assert files.available_prompts(str(tmp_path), "v1") == ["p"]
    df = spark.range(5).withColumnRenamed("id", "run_id")
    assert [r.run_id for r in files.in_order(df, [3, 0]).collect()] == [3, 0]
    got, missing = files.wanted(df.union(df), spark.createDataFrame([(1,), (9,)], "run_id long"))
    assert ids(got) == {1} and ids(missing) == {9} and got.count() == 1
    (tmp_path / "shards").mkdir()
    df.toPandas().to_parquet(tmp_path / "shards" / "public-0.parquet")
    assert files.read_shards(spark, str(tmp_path / "shards"), "public").count() == 5
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, str(tmp_path / "shards"), "other")


def test_stages(spark):
    from loomstat.sources.tables import table

    folder = "/root/testdata/sf0.001"
    settings = ExperimentSettings.of({"strip_system_prompt": True, "chunk": {"unit": "characters", "size": 4000}})
    told = prepared(table(spark, folder, "messages"), settings)
    whole, parts = monitor_whole(told, settings), monitor_chunks(told, settings)
    assert whole.count() == parts.count() > 0
    from loomstat.queries.base import samples

    rows = samples(spark, folder)
    assert all(df.count() >= 0 for df in analyse(rows, settings).values())
    a, b = rows.where("stage = 'global'"), rows.where("stage = 'chunk'")
    assert compare(a, b, settings)["mcnemar"].count() > 0


def test_env_lines(tmp_path):
    (tmp_path / "e").write_text("A = 1\n#B=2\n  export C=\"x = y\"  \nD='it''s'\nE=\nnot a line\nA=2\nF=a#b\r\n")
    env = {"F": "old"}
    assert files.load_env(str(tmp_path / "e"), env=env) == {"A": "1", "C": "x = y", "D": "it''s", "E": ""} and env["F"] == "old"
    assert files.load_env(str(tmp_path / "e"), override=True, env=env)["A"] == "2" and env["F"] == "a#b"
    assert files.load_env(str(tmp_path / "none"), env=env) == {}


def test_a_document_is_whole_or_the_old_one(tmp_path):
    path = tmp_path / "m.json"
    sinks.write_document(str(path), {"a": 1})
    with pytest.raises(ValueError):
        sinks.write_document(str(path), (circle := {}) | {"x": circle.setdefault("x", circle)})
    assert json.loads(path.read_text()) == {"a": 1} and [p.name for p in tmp_path.iterdir()] == ["m.json"]


def test_corrupt_cache_entries_are_misses(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    for name, text in (("1", '{"key": "k1", "score": 7, "reasoning": "r"}'), ("2", '{"key": "k2", "score"'), ("3", '{"key": "k3", "score": 700}'), ("4", '{"score": 3}')):
        (tmp_path / "ab" / f"{name}.json").write_text(text)
    sinks.append_cache(spark.createDataFrame([("k5", 5.0, "r"), ("k6", None, "r")], "key string, score double, reasoning string"), str(tmp_path))
    assert {r.key: r.score for r in files.read_cache(spark, str(tmp_path)).collect()} == {"k1": 7.0, "k5": 5.0}
    with pytest.raises(FileNotFoundError):
        files.read_cache(spark, str(tmp_path / "none"))


def test_stage_and_subset_outputs(spark, meta, tmp_path):
    from loomstat.plans.experiment import provenance, write_stage, write_subset

    settings, folder = ExperimentSettings.of({"name": "x"}), sinks.RunFolder(str(tmp_path), "e", "s")
    tables = {"a": spark.createDataFrame([(1, ["x", "y"], [(1, "p")])], "n int, l array<string>, s array<struct<a:int,b:string>>"), "failed_runs": spark.range(0)}
    told = write_stage(tables, folder, settings, **provenance("chunk", settings, "stand-in", ("text", "abc")))
    assert told["tables"] == ["a"] and told["prompt_sha256"] == "abc" and told["aggregate"]["method"] == "max"
    assert 'x;y,"[{""a"":1,""b"":""p""}]"' in "".join(p.read_text() for p in (tmp_path / "e" / "s" / "a").glob("*.csv"))
    chosen, left = meta.where("run_id < 30"), meta.where("run_id BETWEEN 120 AND 131")
    told = write_subset(chosen, meta, settings, sinks.RunFolder(str(tmp_path), "e", "subset"), left)
    assert told["composition"]["n_selected"] == 30 and told["labels"] == {"bypass_constraints": 20, "sabotage": 10}
    assert told["excluded"] == {"benign": 2, "sandbagging_sabotage": 10}
    ids_ = files.read_jsonl(spark, str(tmp_path / "e" / "subset" / "ids"), chosen.select("run_id").schema)
    assert ids(ids_) == set(range(30))


def test_an_empty_pool_is_an_error(meta):
    with pytest.raises(ValueError):
        select_runs(meta.where("NOT manually_reviewed"), ExperimentSettings())


def test_ids_of_a_trial_run():
    assert files.parse_ids("3,1,2", allowed=[1, 2, 3], calibrate=1) == [1] and files.parse_ids("3,1,2", limit=2, calibrate=5) == [3, 1]


def test_stream(spark, tmp_path):
    from loomstat.operators.scoring import digest_scorer
    from loomstat.streaming.results import score_stream

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    frame = lambda r: spark.createDataFrame(r, "run_id long, chunk_index int, prompt string")
    frame(rows).write.parquet(source)
    stream = lambda: score_stream(spark.readStream.schema(frame([]).schema).parquet(source), digest_scorer, out, mark).awaitTermination()
    stream()
    frame([(1, 0, "a"), (2, 0, "c")]).write.mode("append").parquet(source)
    stream()
    told = spark.read.parquet(out)
    assert sorted((r.run_id, r.chunk_index) for r in told.collect()) == [(1, 0), (1, 1), (2, 0)] and {"shard", "batch"} <= set(told.columns)


def test_tilings_are_told_by_neighbours(spark):
    rows = [(1, 0, 0, 10), (1, 1, 5, 10), (1, 2, 15, 20), (2, 0, 0, 10), (2, 1, 10, 12), (2, 1, 10, 12), (3, 0, 2, 10), (4, 0, 0, 5), (4, 2, 5, 9), (5, 0, None, 4)]
    df = spark.createDataFrame(rows, "run_id long, chunk_index int, start_message int, end_message int")
    assert {r.run_id for r in explore.tiling_faults(df).collect()} == {1, 3, 4, 5}


def test_audit_report_and_recount(spark):
    arm = lambda rows: spark.createDataFrame(rows, "run_id long, score double")
    a, b = arm([(1, 5.0), (2, 5.0), (3, None), (4, 1.0)]), arm([(1, 5.0), (2, 5.0), (3, 5.0)])
    pairs = arm([(1, 5.0), (1, 5.0), (4, 1.0)])
    bad = explore.pair_recount(pairs, a, b, ["run_id"])
    assert sorted((r.run_id, r.n_arms, r.n_pairs) for r in bad.collect()) == [(1, 2, 2), (2, 2, 0), (4, 1, 1)]
    got = {r.check: (r.status, r.n_bad) for r in explore.audit_report({"x": bad, "y": bad.limit(0), "z": bad}, soft=["z"]).collect()}
    assert got == {"x": ("FAIL", 3), "y": ("PASS", 0), "z": ("WARN", 3)}


def test_grid_rows_for_any_number_of_arms(spark):
    from loomstat.operators import themes

    rows = [("a", arm) for arm in "xyz" for _ in range(10)] + [("b", "x")] * 25 + [("c", "y")] * 30
    got = themes.grid_rows(spark.createDataFrame(rows, "label string, arm string"), ["label"], "arm").collect()
    assert sorted(map(tuple, got)) == sorted((label, arm) for label in "ac" for arm in "xyz")


def test_quantiles_and_ranks_from_counts(spark):
    import numpy as np
    import pandas as pd

    from loomstat.operators import counted

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 3_000), "v": np.round(rng.lognormal(3, 2, 3_000)), "w": rng.integers(0, 8, 3_000)})
    df = spark.createDataFrame([(g, None if k % 11 == 0 else float(v), int(w)) for k, (g, v, w) in enumerate(zip(pdf.g, pdf.v, pdf.w, strict=True))], "g string, v double, w int")
    pdf.loc[pdf.index % 11 == 0, "v"] = np.nan
    got = {r.g: r for r in counted.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.97}, {"n": F.sum("_n")}).collect()}
    ranks = {r.g: r for r in counted.rank_sums(df, ["g"], "v", "w").collect()}
    for key in ("a", "b", None):
        part = pdf[pdf.g.isna() if key is None else pdf.g == key].dropna(subset=["v"])
        assert [got[key].a, got[key].b, got[key].c] == pytest.approx(list(np.quantile(part.v, [0.1, 0.5, 0.97]))) and got[key].n == len(part)
        assert ranks[key].rho == pytest.approx(part.v.rank().corr(part.w.rank())) and ranks[key].mean_y == pytest.approx(part.w.mean())
    assert counted.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
