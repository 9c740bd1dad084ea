"""Texts that were cut off, by a length limit or in transfer, and how often each source cuts.

Two kinds of evidence are combined per source:

* Lengths. Of each source the finished lengths follow a log-normal distribution that a limit may censor on
  the right. Lengths (in characters and in bytes) with far more texts than the fit allows are
  candidate limits; the fit is by maximum likelihood with the texts at a candidate counted as
  censored. A text at a candidate limit has the censoring posterior S / (S + f): the mass
  beyond the limit against the mass at it. Any other text has the source's share of cuts elsewhere.
* Endings. The last token, the one before and what follows it (punctuation, marks, open brackets) are
  compared with the insides of all texts of the source: how often does a token sequence end a sentence
  there, and how often is it, or the beginning of a longer token, found anywhere. A cut
  falls anywhere, an end only where sentences end. Endings that recur far more often than
  cuts explain are a manner of the source.
* What the writer said of the end (``finish_reason``), if a column of it is named: noisy, so its shares
  among finished and cut texts are found per source like those of the forms.

The weights of the forms of ending among finished and cut texts are not known; they are found by
expectation-maximization, per source, on a histogram of the evidence. All counts are
over all rows; only per-source histograms meet in one task, of lengths a row for each distinct one.
A run without blanks longer than ``TOKEN_CHARACTERS`` is several tokens, so that the beginnings of tokens stay few
however long an unbroken text is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import SPACE_CLASS, SPACES, strip
from loomstat.session import checkpoint_dir

# What a cut may leave behind at the end of a text.
MARKS = r"(?:\.\.\.|…|[\[<(]\s?(?:truncated|cut|snip|snipped|cut off|continued|more|\.\.\.|…)\s?[\]>)]|�)"
HAN_TAIL = "，。；：！？、）》」』”’…"
#: Longer runs without blanks are taken in pieces of so many characters.
TOKEN_CHARACTERS = 64
#: A Han character with the punctuation behind it, or a run without blanks.
TOKEN = rf"\p{{IsHan}}[{HAN_TAIL}]{{0,{TOKEN_CHARACTERS}}}|[^{SPACE_CLASS}\p{{IsHan}}]{{1,{TOKEN_CHARACTERS}}}"
#: Characters at the end in which the mark of a cut is looked for.
MARK_REACH = 1_000
#: What ends a sentence, with closing quotes and brackets.
STOP = r"[.!?。！？][\"')\]”’」』）]*$"
START = r"^[\p{Lu}\p{IsHan}\p{N}\"'`(\[“‘]"
#: A last line that is an item of a list.
ITEM = r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]"
#: Punctuation after which a text goes on.
GOES_ON = (",", ";", ":", "—", "–", "-", "(", "，", "；", "、")
#: A form of ending without a stop is one of finished texts if it has this share of them at least.
LEAST_FORM = 0.003
#: Weight of the shorter context where the longer was seldom seen.
BACK = 2.0
#: A length that is a candidate limit has so many times the texts that are expected, and this many at least.
SPIKE, LEAST = 5.0, 12
ROUNDS = 40
#: Texts that a source's reasons are counted with besides its own, in the shares of all its texts.
REASON_PRIOR = 20.0
#: Frames with a row per source are broadcast up to so many sources; beyond, they are joined by a shuffle.
FEW_SOURCES = 10_000


def _alike(text: Column) -> Column:
    """File names between backticks and numbers made alike: one or two digits become 0, more 00."""
    named = F.regexp_replace(text, "`[^`\\s]*+`", "`p`")
    return F.regexp_replace(F.regexp_replace(named, "[0-9]{3,}", "00"), "(?<![0-9])[0-9]{1,2}(?![0-9])", "0")


def endings(texts: DataFrame, key: str, source: str, text: str, reason: str | None = None) -> DataFrame:
    """``key, source, reason, tokens, last, before, form, n_chars, n_bytes`` of each non-blank text.

    File names between backticks and numbers are made alike. ``last`` is the last token without the
    punctuation at its end, lower case; ``form`` is that punctuation, the mark of a cut, '{' where
    a bracket, quote or backtick is left open, and '-' in front where the last line is an item. NULL sources
    form one source, ''; so do NULL reasons, which are lower case without outer blanks.
    """
    said = F.lower(strip(F.coalesce(F.col(reason), F.lit("")))) if reason else F.lit("")
    rows = texts.select(
        F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), said.alias("reason"), F.col(text).alias("raw"),
        F.rtrim(F.col(text), F.lit(SPACES)).alias("t"),
    )
    rows = rows.where(F.length("t") > 0).withColumn("t", _alike(F.col("t")))
    tail = F.right("t", F.lit(MARK_REACH))
    rows = rows.withColumn("mark", F.regexp_extract(tail, f"(?i)[{SPACE_CLASS}]*({MARKS})+$", 0))
    rows = rows.withColumn("base", F.expr("left(t, length(t) - length(mark))"))
    # one pass over the text leaves only what opens and closes
    rows = rows.withColumn("pairs", F.regexp_replace("t", "[^`\"(（)）\\[\\]“”]+", ""))
    rows = rows.withColumn("tokens", F.regexp_extract_all("base", F.lit(TOKEN), F.lit(0)))
    count = lambda x: F.length("pairs") - F.length(F.translate("pairs", x, ""))
    open_ = (count("`") % 2 == 1) | (count('"') % 2 == 1) | (count("(（") > count(")）")) | (count("[") > count("]")) | (count("“") > count("”"))
    final = F.coalesce(F.try_element_at("tokens", F.lit(-1)), F.lit(""))
    rows = rows.select("*", final.alias("final"), open_.alias("open"))
    return rows.select(
        "key",
        "source",
        "reason",
        "tokens",
        F.lower(core(F.col("final"))).alias("last"),
        F.lower(F.coalesce(F.try_element_at("tokens", F.lit(-2)), F.lit("^"))).alias("before"),
        F.concat(
            F.when(F.substring_index("base", "\n", -1).rlike(ITEM), "-").otherwise(""),
            F.right(punctuation(F.col("final")), F.lit(4)),
            F.when(F.col("mark") != "", F.concat(F.lit("|"), F.lower(F.trim("mark")))).otherwise(""),
            F.when(F.col("open"), "{").otherwise(""),
        ).alias("form"),
        F.length("raw").alias("n_chars"),
        F.octet_length("raw").alias("n_bytes"),
    )


_PUNCTUATION = r"[^\p{L}\p{M}\p{N}%`]*$"


def punctuation(token: Column) -> Column:
    return F.regexp_extract(token, _PUNCTUATION, 0)


def core(token: Column) -> Column:
    return F.regexp_replace(token, _PUNCTUATION, "")


def sentence_manner(ends: DataFrame) -> DataFrame:
    """``source, stopped, n_texts``: whether most texts of a source end in a stop, and how many it has."""
    stop = F.col("form").rlike(STOP)
    return ends.groupBy("source").agg((F.avg(stop.cast("double")) > 0.5).alias("stopped"), F.count(F.lit(1)).alias("n_texts"))


def inside_counts(ends: DataFrame) -> DataFrame:
    """``source, before, word, n, n_stop, n_part``: token pairs inside the texts, all of them.

    ``n_stop`` counts those that end a sentence, ``n_part`` those that end a part set off by a semicolon
    or line. The last token of a text is not inside.
    """
    pair = F.transform(
        F.slice("tokens", 1, F.size("tokens") - 1),
        lambda t, i: F.struct(
            F.coalesce(F.get("tokens", i - 1), F.lit("^")).alias("before"),
            t.alias("token"),
            F.coalesce(F.get("tokens", i + 1).rlike(START), F.lit(False)).alias("starts"),
        ),
    )
    rows = ends.where(F.size("tokens") > 1).select("source", F.inline(pair))
    some = rows.groupBy("source", "before", "token", "starts").agg(F.count(F.lit(1)).alias("n"))
    stop = punctuation(F.col("token")).rlike(STOP) & F.col("starts")
    part = punctuation(F.col("token")).rlike("[;；]$")
    one = some.select(
        "source", F.lower("before").alias("before"), F.lower(core(F.col("token"))).alias("word"), "n",
        F.when(stop, F.col("n")).otherwise(0).alias("n_stop"), F.when(part, F.col("n")).otherwise(0).alias("n_part"),
    )
    return one.groupBy("source", "before", "word").agg(F.sum("n").alias("n"), F.sum("n_stop").alias("n_stop"), F.sum("n_part").alias("n_part"))


def _prefixes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(word)), lambda k: F.left(word, k))


# lengths


def fit_lengths(length: np.ndarray, n: np.ndarray, limits: Sequence[int], rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of the log lengths by maximum likelihood, texts at ``limits`` censored there."""
    x = np.log(np.maximum(length, 1))
    held = np.isin(length, limits)
    mean = np.average(x, weights=n)
    dev = max(0.05, math.sqrt(np.average((x - mean) ** 2, weights=n)))
    for _ in range(rounds if held.any() else 1):
        z = (x[held] - mean) / dev
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12)
        first, second = x.copy(), x**2
        first[held] = mean + dev * hazard
        second[held] = mean**2 + dev**2 + dev * (x[held] + mean) * hazard
        new = np.average(first, weights=n)
        dev = max(0.05, math.sqrt(max(1e-6, np.average(second, weights=n) - new**2)))
        mean = new
    return mean, dev


def _near(length: np.ndarray, n: np.ndarray, found: Sequence[int]) -> np.ndarray:
    """Texts per length around each of the sorted ``length``, those at it and at ``found`` aside."""
    n = np.where(np.isin(length, found), 0.0, n)
    sums = np.concatenate([[0.0], np.cumsum(n)])
    reach = np.maximum(4, length // 20)
    low, high = np.searchsorted(length, length - reach), np.searchsorted(length, length + reach, side="right")
    return (sums[high] - sums[low] - n) / (2 * reach)


def _mass(mean: float, dev: float, low: float, high: float) -> float:
    at = lambda v: 0.5 * math.erfc(-(math.log(max(v, 0.5)) - mean) / dev / math.sqrt(2))
    return max(1e-12, at(high) - at(low))


def candidate_limits(length: np.ndarray, n: np.ndarray) -> list[tuple[int, float]]:
    """Candidate limits of one source with the censoring posterior at each, until no length is odd."""
    order = np.argsort(length)
    length, n = length[order], n[order].astype(float)
    found: list[int] = []
    while True:
        mean, dev = fit_lengths(length, n, found)
        near = _near(length, n, found)
        total = n.sum()
        fit = np.array([total * _mass(mean, dev, v - 0.5, v + 0.5) for v in length])
        odd = (n > SPIKE * np.maximum(near, np.minimum(fit, near + 1))) & (n >= np.maximum(LEAST, 0.004 * n.sum())) & ~np.isin(length, found) & (length >= 16)
        if not odd.any():
            break
        found.append(int(length[np.where(odd, n, 0).argmax()]))
    out = []
    for limit in found:
        mean, dev = fit_lengths(length, n, found)
        beyond, at = _mass(mean, dev, limit + 0.5, 1e12), _mass(mean, dev, limit - 0.5, limit + 0.5)
        out.append((limit, min(0.999, beyond / (beyond + at))))
    return out


def limits(ends: DataFrame) -> DataFrame:
    """``source, unit, length, censored``: the candidate limits. One histogram per source and unit, a row for each distinct length."""
    both = F.expr("stack(2, 'chars', cast(n_chars as long), 'bytes', cast(n_bytes as long)) as (unit, length)")
    hist = ends.select("source", both).groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        got = candidate_limits(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame(
            {"source": pdf["source"].iloc[0], "unit": pdf["unit"].iloc[0], "length": [g[0] for g in got], "censored": [g[1] for g in got]}
        )

    return hist.groupBy("source", "unit").applyInPandas(find, "source string, unit string, length long, censored double")


# evidence


def _by_source(df: DataFrame, told: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Joins a frame with one row per source; it is broadcast where the sources were counted and are few."""
    return df.join(F.broadcast(told) if few else told, "source", how)


def evidence(ends: DataFrame) -> DataFrame:
    """Per text ``reason``, ``form``, ``ratio`` (end against anywhere, from the insides), ``manner`` (recurring endings) and ``censored``.

    ``ratio`` is P(context | finished) / P(context | cut), ``manner`` what recurring endings add to it; both natural
    numbers, not logs. ``censored`` is NULL away from limits.
    """
    few = ends.select("source").distinct().limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    manner = sentence_manner(ends)
    pairs = _by_source(inside_counts(ends), manner, few).select(
        "source", "before", "word", F.col("n").alias("n_all"),
        F.when(F.col("stopped"), F.col("n_stop")).otherwise(F.col("n_part")).alias("n_end"),
    ).checkpoint()  # read five times below
    words = pairs.groupBy("source", "word").agg(F.sum("n_all").alias("n_all"), F.sum("n_end").alias("n_end"))
    ended = pairs.where("n_end > 0").select("source", F.col("before"), F.col("word").alias("last"), "n_end")
    word_ended = words.where("n_end > 0").select("source", F.col("word").alias("last"), F.col("n_end").alias("w_end"))
    parts = pairs.select("source", "before", F.explode(_prefixes(F.col("word"))).alias("last"), "n_all").groupBy("source", "before", "last").agg(F.sum("n_all").alias("n_pre"))
    word_parts = words.select("source", F.explode(_prefixes(F.col("word"))).alias("last"), "n_all").groupBy("source", "last").agg(F.sum("n_all").alias("w_pre"))
    totals = pairs.groupBy("source").agg(
        F.sum(F.col("n_all") * (F.length("word") + 1)).cast("double").alias("places"), F.sum("n_end").cast("double").alias("stops")
    )
    keys = ends.groupBy("source", "form", "before", "last").agg(F.count(F.lit(1)).alias("n_key"))
    keys = _by_source(keys, manner, few)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    # sources of the same manner lend each other their recurring endings
    every = keys.groupBy("stopped", "form", "before", "last").agg(F.sum("n_key").alias("n_key_all"))
    joined = (
        keys.join(every, ["stopped", "form", "before", "last"])
        .join(manner.groupBy("stopped").agg(F.sum("n_texts").alias("n_texts_all")), "stopped")
        .join(ended, ["source", "before", "last"], "left")
        .join(parts, ["source", "before", "last"], "left")
        .join(word_ended, ["source", "last"], "left")
        .join(word_parts, ["source", "last"], "left")
    )
    joined = _by_source(joined, totals, few, "left")
    places, stops = F.greatest(zero("places"), F.lit(1.0)), F.greatest(zero("stops"), F.lit(1.0))
    short = (zero("w_end") + 0.01 * BACK) / (zero("w_pre") + BACK)
    share = (zero("n_end") + BACK * short) / (zero("n_pre") + BACK)
    anywhere = (zero("n_pre") + BACK * zero("w_pre") / places + 0.05) / places
    # recurring endings: what is beyond the number that cuts would leave if every text were cut, with a wide margin; the text itself doesn't count
    expected = F.col("n_texts") * anywhere
    beyond = lambda seen, by_chance: F.greatest(F.lit(0.0), F.col(seen) - 1 - (by_chance + 3 * F.sqrt(by_chance) + 2))
    own = beyond("n_key", expected) / F.col("n_texts")
    by_all = beyond("n_key_all", F.col("n_texts_all") * anywhere) / F.col("n_texts_all")
    scored = joined.select(
        "source", "form", "before", "last",
        F.least(F.lit(1e4), F.greatest(F.lit(1e-6), share * places / stops)).alias("ratio"),
        F.least(F.lit(1e6), F.greatest(own, by_all / 2) / anywhere).alias("manner"),
    )
    at = limits(ends).groupBy("source").agg(F.collect_list(F.struct("unit", "length", "censored")).alias("limits"))
    texts = _by_source(ends.select("key", "source", "reason", "form", "before", "last", "n_chars", "n_bytes"), at, few, "left")
    size = lambda x: F.when(x["unit"] == "chars", F.col("n_chars")).otherwise(F.col("n_bytes"))
    hit = F.array_max(F.transform(F.filter("limits", lambda x: x["length"] == size(x)), lambda x: x["censored"]))
    texts = texts.select("key", "source", "reason", "form", "before", "last", hit.alias("censored"))
    return texts.join(scored, ["source", "form", "before", "last"])


def _weights(hist: pd.DataFrame) -> pd.DataFrame:
    """The weight of each form and reason among finished and cut texts of one source, by expectation-maximization."""
    forms, reasons = sorted(hist["form"].unique()), sorted(hist["reason"].unique())
    g = hist["reason"].map({x: k for k, x in enumerate(reasons)}).to_numpy()
    f = hist["form"].map({x: k for k, x in enumerate(forms)}).to_numpy()
    n = hist["n"].to_numpy(float)
    a, b = np.exp(hist["log_ratio"].to_numpy()), np.where(hist["log_manner"] > -50, np.exp(hist["log_manner"].to_numpy()), 0.0)
    censored = hist["censored"].to_numpy(float)
    plain = np.isnan(censored)
    marked = np.array(["|" in x for x in forms])
    start = np.array([0.8 if x in ("", "-") else 0.05 if "|" in x else 0.02 if x.strip("-{") in ("", *GOES_ON) else 0.004 for x in forms])
    stops = np.array([re.search(STOP, x) is not None and "|" not in x and "{" not in x for x in forms])
    going_on = np.array(["{" in x or x.endswith(GOES_ON) and x != "-" for x in forms])
    prior_cut = start / start.sum()
    fin = np.bincount(f, weights=n, minlength=len(forms)) + 0.5
    fin = np.where(marked, 0.3 * fin, np.where(going_on, 0.02 * fin, fin))
    fin, cut = fin / fin.sum(), prior_cut.copy()
    share = 0.05
    every = np.bincount(g, weights=n, minlength=len(reasons)) / n.sum()
    said_fin, said_cut = every.copy(), every.copy()
    for _ in range(ROUNDS):
        prior = np.where(plain, share, np.nan_to_num(censored, nan=share))
        c, d = prior * cut[f] * said_cut[g], (1 - prior) * (fin[f] * a + b) * said_fin[g]
        post = c / np.maximum(c + d, 1e-300)
        own = np.where(fin[f] * a + b > 0, fin[f] * a / np.maximum(fin[f] * a + b, 1e-300), 1.0)
        cut = np.bincount(f, weights=n * post, minlength=len(forms)) + 5.0 * prior_cut
        fin = np.bincount(f, weights=n * (1 - post) * own, minlength=len(forms))
        fin = np.maximum(fin - np.where(stops, 0.0, np.maximum(3.0, LEAST_FORM * n.sum())), 0.01)
        cut, fin = cut / cut.sum(), fin / fin.sum()
        said_cut = np.bincount(g, weights=n * post, minlength=len(reasons)) + REASON_PRIOR * every
        said_fin = np.bincount(g, weights=n * (1 - post), minlength=len(reasons)) + REASON_PRIOR * every
        said_cut, said_fin = said_cut / said_cut.sum(), said_fin / said_fin.sum()
        share = float(np.clip((n * post)[plain].sum() / max(n[plain].sum(), 1), 1e-4, 1 - 1e-4))
    k = np.unique(f * len(reasons) + g)
    f, g = k // len(reasons), k % len(reasons)
    return pd.DataFrame(
        {
            "source": hist["source"].iloc[0], "form": [forms[x] for x in f], "reason": [reasons[x] for x in g],
            "w_finished": fin[f], "w_cut": cut[f], "said": said_cut[g] / said_fin[g], "share": share,
        }
    )


def cut_probability(texts: DataFrame, key: str, source: str, text: str, reason: str | None = None) -> DataFrame:
    """``key, source, p_cut`` of every text that isn't NULL or blank; one row per row.

    ``p_cut`` is the posterior that the text was cut inside a word or sentence. A source with
    few texts leans on the starting weights. ``reason`` names a column that says why a text ended, NULL
    where it doesn't. Columns of other names are not looked at.
    """
    checkpoint_dir(texts.sparkSession)
    ends = endings(texts, key, source, text, reason).checkpoint()  # every count below reads it
    told = evidence(ends)
    half = lambda c: F.round(F.ln(c) * 2) / 2
    told = told.select(
        "*", half(F.col("ratio")).alias("log_ratio"), F.coalesce(F.when(F.col("manner") > 0, half(F.col("manner"))), F.lit(-99.0)).alias("log_manner")
    )
    hist = told.groupBy("source", "form", "reason", "log_ratio", "log_manner", F.round("censored", 2).alias("censored")).agg(F.count(F.lit(1)).alias("n"))
    weights = hist.groupBy("source").applyInPandas(
        _weights, "source string, form string, reason string, w_finished double, w_cut double, said double, share double"
    )
    prior = F.coalesce("censored", "share")
    cut = prior * F.col("w_cut") * F.col("said")
    finished = (1 - prior) * (F.col("w_finished") * F.col("ratio") + F.col("manner"))
    return told.join(weights, ["source", "form", "reason"]).select("key", "source", (cut / (cut + finished)).alias("p_cut"))


# What the project's tables ask for


def reasonings(completions: DataFrame) -> DataFrame:
    """``completion_id, model, finish_reason, reasoning``, a repeated completion once (the latest called holds)."""
    last = completions.where(F.col("completion_id").isNotNull()).groupBy("completion_id").agg(
        F.max(F.struct("called_at", "model", F.col("parsed.reasoning").alias("reasoning"), "finish_reason")).alias("r")
    )
    return last.select("completion_id", "r.model", "r.finish_reason", "r.reasoning")


def judged(completions: DataFrame) -> DataFrame:
    return cut_probability(reasonings(completions), "completion_id", "model", "reasoning", "finish_reason").select(
        F.col("key").alias("completion_id"), F.col("source").alias("model"), "p_cut"
    )


def cut_completions(completions: DataFrame) -> DataFrame:
    """Once each completion whose reasoning was cut off: ``completion_id, model, p_cut``."""
    return judged(completions).where("p_cut > 0.5")


def cut_rates(completions: DataFrame) -> DataFrame:
    """``model, n_reasonings, n_cut, share_cut``; only reasonings with text are counted."""
    one = F.when(F.col("p_cut") > 0.5, 1).otherwise(0)
    return judged(completions).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_reasonings"), F.sum(one).alias("n_cut"), F.avg(one.cast("double")).alias("share_cut")
    )
