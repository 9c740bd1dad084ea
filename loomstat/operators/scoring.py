"""Scoring prompts: pluggable scorers, a content-addressed cache, resuming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.fixed import CHARS_PER_TOKEN

#: A scorer reads ``prompt`` and gives back the frame with ``score`` (double), ``reasoning`` and ``error``.
Scorer = Callable[[DataFrame], DataFrame]


def digest_score(prompt: Column) -> Column:
    """A stand-in for a model: a score from 0 to 100 out of the prompt's digest."""
    return (F.conv(F.substring(F.md5(prompt), 1, 6), 16, 10).cast("int") % 101).cast("double")


def digest_scorer(prompts: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return prompts.withColumns({"score": digest_score(F.col("prompt")), "reasoning": none, "error": none})


#: What a scorer's answer adds to a prompt.
ANSWER = "score double, reasoning string, error string, finish_reason string, prompt_tokens long, completion_tokens long"


def time_limit(characters: int) -> float:
    """Seconds a call may take: two minutes and 0.6 per thousand tokens, fifteen minutes at most."""
    return min(120 + characters / CHARS_PER_TOKEN / 1000 * 0.6, 900.0)


def judge_answer(answer: Mapping[str, Any]) -> dict[str, Any]:
    """One row of ``ANSWER`` out of what a model gave: a score, or the error that it stands for.

    A finish for length is ``TruncatedResponseError``, a refusal ``RefusalError``, an answer without a whole score from 0 to 100
    ``InvalidVerdictError``. What was used of tokens counts in any case.
    """
    used = {c: int(answer.get(c) or 0) for c in ("prompt_tokens", "completion_tokens")}
    score, error = answer.get("score"), None
    if answer.get("finish_reason") == "length":
        error = "TruncatedResponseError"
    elif answer.get("refusal"):
        error = "RefusalError"
    elif isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 100 or score != int(score):
        error = "InvalidVerdictError"
    return {
        "score": None if error else float(score), "reasoning": None if error else answer.get("reasoning"), "error": error,
        "finish_reason": answer.get("finish_reason"), **used,
    }


def prompt_scorer(call: Callable[[str, float], Mapping[str, Any]], most_characters: int, parallel: int | None = None, retries: int = 0) -> Scorer:
    """A scorer around a call of a model: ``call(prompt, seconds)`` gives ``score, reasoning`` and, if known, ``finish_reason, refusal,
    prompt_tokens, completion_tokens``.

    Prompts beyond ``most_characters`` are refused (``TranscriptTooLargeError``) before any call. A call that raises is made again
    ``retries`` times, then gives an error row (``UpstreamError: `` and what was raised) and leaves the others of its batch alone.
    ``parallel`` bounds how many tasks call at a time.
    """

    def one(prompt: str) -> dict[str, Any]:
        for left in range(retries, -1, -1):
            try:
                return judge_answer(call(prompt, time_limit(len(prompt))))
            except Exception as error:  # failures become rows
                if not left:
                    return judge_answer({}) | {"error": f"UpstreamError: {type(error).__name__}"}
        raise ValueError("retries must not be negative")

    return _scorer(lambda prompts: [one(p) for p in prompts], most_characters, parallel)


def batch_scorer(score: Callable[[list[str]], list[Mapping[str, Any]]], most_characters: int, parallel: int | None = None) -> Scorer:
    """As ``prompt_scorer``, around a function from many prompts to their answers, called once per Arrow batch.

    If it raises, each prompt of the batch is scored by itself: only those that raise again are error rows.
    """

    def alone(prompt: str) -> dict[str, Any]:
        try:
            return judge_answer(score([prompt])[0])
        except Exception as error:  # failures become rows
            return judge_answer({}) | {"error": f"UpstreamError: {type(error).__name__}"}

    def many(prompts: list[str]) -> list[dict[str, Any]]:
        try:
            answers = score(prompts)
            if len(answers) != len(prompts):
                raise ValueError("as many answers as prompts are needed")
            return [judge_answer(a) for a in answers]
        except Exception:  # told apart one by one
            return [alone(p) for p in prompts]

    return _scorer(many, most_characters, parallel)


def _scorer(answers: Callable[[list[str]], list[dict[str, Any]]], most_characters: int, parallel: int | None) -> Scorer:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = pd.DataFrame(answers(pdf["prompt"].tolist()), columns=[c.split()[0] for c in ANSWER.split(", ")], index=pdf.index)
            yield pd.concat([pdf, told], axis=1)

    def scorer(prompts: DataFrame) -> DataFrame:
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
        fits = F.coalesce(F.length("prompt") <= most_characters, F.lit(False))
        ready = prompts.where(fits)
        if parallel:
            ready = ready.repartition(parallel)
        done = ready.mapInPandas(run, f"{own}, {ANSWER}")
        nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ANSWER.split(", ")}
        why = F.when(F.col("prompt").isNull(), "EmptyTranscript").otherwise("TranscriptTooLargeError")
        return done.unionByName(prompts.where(~fits).withColumns(nothing | {"error": why}))

    return scorer


def usage(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, failures by kind of row and tokens of scored prompts."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count("error").alias("n_failed"),
        *(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("prompt_tokens", "completion_tokens")),
    )


def cache_key(model: str, system: str, prompt: Column, options: str = "") -> Column:
    """The address of a call: a digest of everything that decides its answer."""
    fields = F.struct(F.lit(model).alias("model"), F.lit(options).alias("options"), prompt.alias("prompt"), F.lit(system).alias("system"))
    return F.sha2(F.to_json(fields), 256)


def cached(prompts: DataFrame, cache: DataFrame, scorer: Scorer, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Scores each distinct missing key once. Gives the scored prompts and the new cache rows to append.

    A cache row without a score from 0 to 100 is corrupt: it is a miss and scored anew.
    """
    cache = cache.where(F.col("score").between(0, 100))
    missing = prompts.join(cache, key, "left_anti").dropDuplicates([key])
    fresh = scorer(missing).where("error IS NULL").select(key, "score", "reasoning")
    known = cache.select(key, "score", "reasoning").unionByName(fresh)
    return prompts.join(known, key, "left"), fresh


def incomplete(results: DataFrame, retry_partial: bool = False) -> Column:
    """A result to score again: it failed or, on request, some of its chunks did."""
    bad = F.col("error").isNotNull()
    if retry_partial:
        bad = bad | F.exists("chunk_verdicts", lambda v: v["score"].isNull() | F.isnan(v["score"]))
    return bad


def pending(wanted: DataFrame, results: DataFrame, retry_partial: bool = False) -> DataFrame:
    """The wanted rows (by ``run_id``) that have no complete result yet."""
    return wanted.join(results.where(~incomplete(results, retry_partial)), "run_id", "left_anti")
