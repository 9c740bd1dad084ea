"""Sources and sinks: tables are written, read back and compared with what they were.

Files go to the folder that all executors share.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstat.plans.config import ExperimentSettings
from loomstat.plans.experiment import write_subset
from loomstat.queries import base
from loomstat.queries.registry import query
from loomstat.session import checkpoint_dir
from loomstat.sources import files, sinks
from loomstat.sources.tables import table

_S, _M = f"WITH {base.SAMPLES} ", f"WITH {base.META} "


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid4().hex}"


_RESULT = "run_id, monitor, score, error, is_positive, n_chunks, line_no"


@query(f"WITH last AS (SELECT *, row_number() OVER (PARTITION BY run_id, monitor ORDER BY line_no DESC) AS k FROM monitor_results) SELECT {_RESULT.replace('score', 'CASE WHEN NOT isnan(score) THEN score END AS score')} FROM last WHERE k = 1")
def jsonl_round_trip(spark, folder):
    """Results as JSON lines, appended to twice, with the last line of each key read back."""
    rows = table(spark, folder, "monitor_results").select(*_RESULT.split(", ")).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    path = _folder(spark)
    sinks.write_jsonl(rows.where("monitor = 'global'"), path)
    sinks.append_jsonl(rows.where("NOT monitor <=> 'global'"), path)
    return files.last_by_line(files.read_jsonl(spark, path, rows.schema), ["run_id", "monitor"])


@query(_S + "SELECT experiment, stage, run_id, score, is_positive, label_text AS labels, nullif(reasoning, '') AS reasoning FROM samples")
def csv_round_trip(spark, folder):
    """Per-sample rows as CSV, label lists joined, and read back."""
    rows = base.samples(spark, folder).select("experiment", "stage", "run_id", "score", "is_positive", "labels", "reasoning")
    path = _folder(spark)
    sinks.write_csv(rows, path)
    told = files.read_csv(spark, path, rows.withColumn("labels", F.lit("")).schema)
    return told.withColumn("labels", F.coalesce("labels", F.lit("")))


@query(_M + "SELECT run_id, md5(task_id) AS task, model, is_positive FROM meta")
def shards_round_trip(spark, folder):
    """Run rows as shards of a split, replaced by a frame that reads them, and read by their pattern."""
    path = _folder(spark)
    rows = base.metadata(spark, folder).select("run_id", F.md5("task_id").alias("task"), "model", "is_positive")
    rows.union(rows).write.parquet(path)
    sinks.rewrite(spark.read.parquet(path).dropDuplicates(["run_id"]), path)
    return files.read_shards(spark, path, "part")


@query(_M + "SELECT run_id, is_positive AS found FROM meta WHERE manually_reviewed")
def wanted_runs(spark, folder):
    """The reviewed runs' ids looked up among the positive runs: those found, a repeated row once, and those missing."""
    meta = base.metadata(spark, folder)
    ids = meta.where("manually_reviewed").select("run_id")
    got, missing = files.wanted(meta.where("is_positive").unionByName(meta.where("is_positive")), ids)
    return got.select("run_id", F.lit(True).alias("found")).unionByName(missing.select("run_id", F.lit(False).alias("found")))


@query(
    _M + """SELECT count(*) AS n_selected, count(*) FILTER (is_positive) AS n_positive, count(*) AS n_ids, (SELECT count(*) FROM meta WHERE coalesce(manually_reviewed, false) AND len(labels) = 0) AS n_unlabelled FROM meta WHERE manually_reviewed"""
)
def subset_manifest(spark, folder):
    """A subset written with its manifest, and both read back."""
    meta = base.metadata(spark, folder)
    chosen = meta.where("manually_reviewed").select("run_id")
    path = _folder(spark)
    where = sinks.RunFolder(path.removeprefix("file://").removeprefix("file:"), "subset", "reviewed")
    write_subset(chosen, meta, ExperimentSettings(), where)
    manifest = files.read_document(spark, where.file("run.json"), StructType.fromDDL("composition struct<n_selected: long, n_positive: long>"))
    ids = files.read_jsonl(spark, where.file("ids"), chosen.schema)
    unlabelled = meta.join(ids, "run_id", "left_semi").where(F.size("labels") == 0).agg(F.count(F.lit(1)).alias("n_unlabelled"))
    counts = ids.agg(F.count(F.lit(1)).alias("n_ids"))
    told: DataFrame = manifest.select("composition.n_selected", "composition.n_positive")
    return told.crossJoin(counts).crossJoin(unlabelled)  # one row each


@query(
    """WITH m AS (SELECT DISTINCT completion_id, md5(parsed.reasoning) AS digest, parsed.score AS score FROM completions WHERE parsed IS NOT NULL AND completion_id IS NOT NULL),
one AS (SELECT digest, max(score) AS score FROM m WHERE digest IS NOT NULL GROUP BY digest) SELECT digest, score::DOUBLE AS score FROM one WHERE score BETWEEN 0 AND 100"""
)
def cache_round_trip(spark, folder):
    """A cache of verdicts, written in folders by key and read back; entries without a score are misses."""
    rows = table(spark, folder, "completions").where("parsed.reasoning IS NOT NULL").groupBy(F.md5("parsed.reasoning").alias("key")).agg(
        F.max("parsed.score").cast("double").alias("score"), F.lit("").alias("reasoning")
    )
    path = _folder(spark)
    sinks.append_cache(rows, path)
    return files.read_cache(spark, path).select(F.col("key").alias("digest"), "score")
