"""The stages of an experiment as plans: select, monitor, analyse, compare.

Each stage is a lazy plan over the frames of the one before; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.fixed import CHARS_PER_TOKEN
from loomstat.operators import aggregation, chunking, figures, lengths, metrics, paired, sampling, transcripts
from loomstat.operators.scoring import Scorer, digest_scorer
from loomstat.plans.config import ExperimentSettings
from loomstat.sources.sinks import RunFolder, write_jsonl


def select_runs(metadata: DataFrame, settings: ExperimentSettings, run_lengths: DataFrame | None = None) -> DataFrame:
    """The ids to monitor. Label quotas come before group quotas, those before a balance; an empty pool is an error."""
    s = settings.subset
    pool = sampling.reviewed(metadata, s.manually_reviewed_only)
    if pool.isEmpty():
        raise ValueError("no runs to select from")
    if s.label_quotas:
        chosen = sampling.by_quota(pool, s.label_quotas, seed=s.seed)
    elif s.family_quotas:
        chosen = sampling.by_quota(pool, s.family_quotas, family=True, seed=s.seed)
    elif s.positive_fraction is None:
        chosen = sampling.uniform(pool, s.n_samples, s.seed)
    else:
        chosen = sampling.balanced(pool, s.n_samples, s.positive_fraction, s.max_prompted_fraction, s.seed)
    chosen = chosen.select("run_id")
    if s.max_tokens and run_lengths is not None:
        chosen, _ = sampling.length_cap(chosen, run_lengths, s.max_tokens)
    return chosen.select("run_id")


def prepared(messages: DataFrame, settings: ExperimentSettings) -> DataFrame:
    told = transcripts.linear_messages(messages)
    return transcripts.redact_echoes(told) if settings.strip_system_prompt else told


def monitor_whole(transcript: DataFrame, settings: ExperimentSettings, scorer: Scorer = digest_scorer) -> DataFrame:
    """One score per run from one prompt; failures are rows with an error."""
    most = int(settings.max_transcript_tokens * CHARS_PER_TOKEN)
    told = chunking.whole_prompts(transcript, most)
    refused = told.where("error IS NOT NULL").select("run_id", F.lit(None).cast("double").alias("score"), "error")
    scored = scorer(told.where("error IS NULL").select("run_id", "prompt")).select("run_id", "score", "error")
    return scored.unionByName(refused)


def monitor_chunks(transcript: DataFrame, settings: ExperimentSettings, scorer: Scorer = digest_scorer) -> DataFrame:
    """Chunk scores, folded into one per run."""
    c = settings.chunk
    if c.unit == "messages":
        prompts = chunking.prompts(transcript, c.size, c.overlap, c.context_messages)
        spans = chunking.windows(transcript.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_messages")), c.size, c.overlap)
    else:
        spans = chunking.character_windows(transcript, c.size, c.overlap)
        prompts = _prompts_of(transcript, spans)
    scored = scorer(prompts.select("run_id", "chunk_index", "prompt"))
    told = spans.select("run_id", "chunk_index", "start_message", "end_message").join(scored, ["run_id", "chunk_index"])
    runs = transcript.select("run_id").distinct()
    return aggregation.run_results(runs, told, settings.aggregate.method, settings.aggregate.top_k)


def _prompts_of(transcript: DataFrame, spans: DataFrame) -> DataFrame:
    told = transcripts.rendered(transcript).select("run_id", "pos", "text")
    within = (F.col("pos") >= F.col("start_message")) & (F.col("pos") < F.col("end_message"))
    body = told.join(spans, "run_id").where(within).groupBy("run_id", "chunk_index").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("m")
    )
    text = F.array_join(F.transform("m", lambda x: x["text"]), "\n\n")
    return body.select("run_id", "chunk_index", F.concat(F.lit("<transcript_chunk>\n"), text, F.lit("\n</transcript_chunk>")).alias("prompt"))


def analyse(samples: DataFrame, settings: ExperimentSettings, by: tuple[str, ...] = ("experiment", "stage")) -> dict[str, DataFrame]:
    """Every table of a stage's results."""
    e = settings.evaluation
    told = metrics.with_outcome(samples, e.threshold)
    return {
        "per_sample": told,
        "report": metrics.report(samples, by, e.threshold, e.target_fpr),
        "score_distribution": metrics.score_distribution(samples, by),
        "recall_by_model": metrics.recall_by(samples, by, "model", e.threshold),
        "recall_by_source": metrics.recall_by(samples, by, "run_source", e.threshold),
        "length_by_label": lengths.length_by_label(samples, by),
        "score_vs_length": lengths.score_vs_length(samples, by),
        "fpr_by_length_decile": lengths.fpr_by_decile(samples, by, e.threshold),
        "failure_digest": figures.failure_digest(samples, by, threshold=e.threshold),
        "failed_runs": told.where("outcome = 'ERROR'"),
    }


def compare(baseline: DataFrame, variant: DataFrame, settings: ExperimentSettings, by: tuple[str, ...] = ("experiment",)) -> dict[str, DataFrame]:
    """Every table of two arms on the same runs."""
    t = settings.evaluation.threshold
    both = paired.pair(baseline, variant, [*by, "run_id"], threshold=t)
    return {
        "paired": both,
        "arm_table": paired.arm_table(both, by, t, settings.evaluation.target_fpr),
        "mcnemar": paired.mcnemar(both, by),
        "transitions": paired.transition_counts(both, by),
        "delta_vs_length": paired.delta_vs_length(both, by),
        "length_effect_by_arm": paired.length_effect_by_arm(both, by),
        "recovery_by_length": paired.recovery_by_length(both, by, t),
        "recovery_within_label": paired.recovery_within_label(both, by, t),
        "label_composition": paired.label_composition(both, by),
        "top_recoveries": paired.top_recoveries(both, by),
        "regressions": both.where("transition = 'lost'"),
    }


#: Tables that a stage writes only if they have rows.
MAY_BE_EMPTY = ("failed_runs",)


def write_stage(tables: Mapping[str, DataFrame], folder: RunFolder, settings: ExperimentSettings, **provenance: Any) -> dict[str, Any]:
    """Every table of a stage as CSV, with a manifest of the settings and of what made it."""
    written = folder.write_tables(tables, MAY_BE_EMPTY)
    return folder.write_manifest(tables=written, settings=settings.as_dict(), **provenance)


def provenance(monitor: str, settings: ExperimentSettings, scorer: str, prompt: tuple[str, str] | None = None) -> dict[str, Any]:
    """What has to be known to score the same again: the kind of monitor, its scorer, its prompt's digest and its settings."""
    told: dict[str, Any] = {"monitor": monitor, "scorer": scorer, "strip_system_prompt": settings.strip_system_prompt}
    if prompt is not None:
        told["prompt_sha256"] = prompt[1]
    if monitor == "chunk":
        told |= {"chunk": asdict(settings.chunk), "aggregate": asdict(settings.aggregate)}
    return told


def write_subset(
    chosen: DataFrame, metadata: DataFrame, settings: ExperimentSettings, folder: RunFolder, excluded: DataFrame | None = None
) -> dict[str, Any]:
    """The selected ids in order (``ids``, JSON lines), and a manifest: settings, composition, labels and what a length cap left out.

    Ids are written by the tasks; the manifest holds counts only, so that its size doesn't grow with the selection.
    """
    selected = metadata.join(chosen.select("run_id").distinct(), "run_id", "left_semi")
    ids = selected.select("run_id").repartitionByRange("run_id").sortWithinPartitions("run_id")
    write_jsonl(ids, folder.file("ids"))
    told = {
        "composition": sampling.composition(selected).first().asDict(),
        # a row per label or group: as many as the taxonomy has
        "labels": {r.label: r.n for r in sampling.label_counts(selected).orderBy("label").collect()},
    }
    if excluded is not None:
        left_out = metadata.join(excluded.select("run_id").distinct(), "run_id", "left_semi")
        told["excluded"] = {r.label_group: r.n for r in sampling.excluded_by_group(left_out).orderBy("label_group").collect()}
    return folder.write_manifest(settings=settings.as_dict(), ids="ids", **told)


