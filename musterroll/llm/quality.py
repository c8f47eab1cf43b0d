"""Quality rules whose cutoffs are certified on labelled holdouts.

Each stratum (language) has, for each signal, a grid of cutoffs, tested from
the most lenient on until the first one fails.  A cutoff may be used if an
exact binomial test on the stratum's good labelled documents shows that it
rejects no more than ``risk`` of them.  Testing in a fixed order needs no
correction along the grid; the level is divided by the number of strata and
signals (Bonferroni).  Among the cutoffs that may be used, the one that best
tells labelled junk from good documents is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import text_bytes
from musterroll.runtime import written

# Fixed values of the query's contract.
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\t\n\x0b\x0c\r "
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
WINDOW = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_shouted:bigint,n_upper:bigint>"
NAMES = [part.split(":")[0] for part in COUNTS[7:-1].split(",")]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * _MIX + hashes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Windows with equal hashes are compared word by word.
    inside = np.zeros(n, bool)
    inside[order[1:][same]] = True
    inside[order[:-1][same]] = True
    seen: dict[tuple[bytes, ...], int] = {}
    starts = np.flatnonzero(inside).tolist()
    for i in starts:
        key = tuple(words[i : i + window])
        seen[key] = seen.get(key, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The counts in ``NAMES`` of one text, given as UTF-8."""
    words = raw.split()
    solid = raw.translate(None, BLANKS)
    word_chars = len(solid.decode("utf-8", "replace"))
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words),
        word_chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, b"!?")),
        upper,
    )


def text_counts(text: Column) -> Column:
    """The counts of a text as a struct."""

    @F.arrow_udf(COUNTS)
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [counts_of(raw.as_py()) for raw in batch]
            columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return counted(text_bytes(text))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def signals(at: str = "") -> dict[str, Column]:
    """Shares between 0 and 1, larger for worse; 0 for texts without words."""
    marks = F.col(f"{at}n_symbols") + F.col(f"{at}n_shouted")
    return {
        "marks": F.coalesce(F.least(marks / F.col(f"{at}n_words"), F.lit(1.0)), F.lit(0.0)),
        "upper": F.coalesce(F.col(f"{at}n_upper") / F.col(f"{at}word_chars"), F.lit(0.0)),
    }


@dataclass(frozen=True)
class Settings:
    risk: float = 0.05  # share of good documents of a stratum that may be rejected, over all signals
    error: float = 0.05  # chance that any stratum breaks the promise
    steps: int = 50  # cutoffs tested per signal, evenly from 0 to 1
    cost: float = 20.0  # junk documents that are worth one good document


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) of X ~ Binomial(n, p), summed exactly in logs."""
    if x >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certified(rejected: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound of the rejection rate is at most ``risk``.

    The Clopper-Pearson bound at ``1 - level`` is at most ``risk`` exactly if
    so few rejections would come with a chance of at most ``level`` under it.
    """
    return n > 0 and rejected < risk * n and binomial_tail(rejected, n, risk) <= level


CUTOFFS = "stratum string, signal string, cutoff double, n_good bigint, good_rejected bigint, n_junk bigint, junk_rejected bigint"


def chosen(counts: pd.DataFrame, risk: float, level: float, steps: int, cost: float) -> pd.DataFrame:
    """Best certified cutoff of one stratum and signal, from counts per step; no row without one.

    A document is rejected if its signal is above the cutoff.  Ties go to the
    most lenient cutoff.
    """
    good, junk = np.zeros(steps + 1, np.int64), np.zeros(steps + 1, np.int64)
    for step, quality, n in zip(counts["step"], counts["quality"], counts["n"], strict=True):
        (good if quality == 1 else junk)[int(step)] += n
    best = None
    for k in range(steps - 1, -1, -1):  # cutoff k/steps rejects what lies in later steps
        lost, caught = int(good[k + 1 :].sum()), int(junk[k + 1 :].sum())
        if not certified(lost, int(good.sum()), risk, level):
            break
        worth = caught - cost * lost
        if worth > 0 and (best is None or worth > best[0]):
            best = worth, k / steps, lost, caught
    columns = [c.split()[0] for c in CUTOFFS.split(", ")]
    if best is None:
        return pd.DataFrame(columns=columns)
    _, cutoff, lost, caught = best
    row = (counts["stratum"].iloc[0], counts["signal"].iloc[0], cutoff, int(good.sum()), lost, int(junk.sum()), caught)
    return pd.DataFrame([row], columns=columns)


def cutoffs(counted: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cutoffs of every stratum and signal, from ``counted`` (with ``stratum``) and ``labels``.

    All labelled documents take part; only counts per stratum, signal and step
    are gathered, at most ``steps`` + 1 for each.  Documents that the base
    rules reject are left out, since no cutoff decides on them.  A label that
    is null, neither 0 nor 1, or contradicted for its id is left out.
    """
    named = signals()
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__most"))
    known = known.filter(F.col("quality") == F.col("__most")).select("doc_id", "quality")
    held = counted.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(known, "doc_id")
    each = held.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("value")) for k, v in named.items()])).alias("s"))
    step = F.ceil(F.col("s.value") * settings.steps).cast("int")
    counts = written(each.groupBy("stratum", "quality", F.col("s.signal").alias("signal"), step.alias("step")).agg(F.count("*").alias("n")), "quality-counts")
    strata = counts.select("stratum").distinct().count()
    level = settings.error / max(1, strata * len(named))
    risk = settings.risk / len(named)
    steps, cost = settings.steps, settings.cost
    return counts.groupBy("stratum", "signal").applyInPandas(lambda rows: chosen(rows, risk, level, steps, cost), CUTOFFS)


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def certified_cutoffs(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Counts of every row of ``docs``, and the table of cutoffs, both written."""
    slim = docs.select("doc_id", _stratum().alias("stratum"), text_counts(F.col("text")).alias("c"))
    counted = written(slim.select("doc_id", "stratum", "c.*"), "quality-counted")
    return counted, written(cutoffs(counted, labels, settings), "quality-cutoffs")


def with_verdict(counted: DataFrame, found: DataFrame, stratum: str, at: str = "") -> DataFrame:
    """Adds ``__failed`` and ``__kept``; the table of cutoffs has a few rows per stratum."""
    wide = found.groupBy(F.col("stratum").alias("__cut_of")).agg(
        *[F.max(F.when(F.col("signal") == k, F.col("cutoff"))).alias(f"__most_{k}") for k in signals()]
    )
    failed = base_failed(F.col(f"{at}n_words"), F.col(f"{at}n_repeat_words"))
    over = F.lit(False)
    for k, v in signals(at).items():
        over = over | F.coalesce(v > F.col(f"__most_{k}"), F.lit(False))
    out = counted.join(wide, F.col(stratum) == F.col("__cut_of"), "left")
    return out.withColumn("__failed", failed).withColumn("__kept", ~failed & ~over)


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    ``docs`` needs ``doc_id, text, lang``.  A null text has no words and fails
    the base rules.  Rows without a language form a stratum; a stratum with
    too few labels gets no cutoff and keeps all that the base rules pass.
    Rows without an id have no label; repeated rows are judged alike.
    """
    counted, found = certified_cutoffs(docs, labels, settings)
    out = with_verdict(counted, found, "stratum")
    return out.select("doc_id", *NAMES[:5], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with all their columns.

    Counting twice is cheaper than shuffling all texts to join a verdict.
    """
    _, found = certified_cutoffs(docs, labels, settings)
    rows = docs.withColumn("__stratum", _stratum()).withColumn("__c", text_counts(F.col("text")))
    return with_verdict(rows, found, "__stratum", "__c.").filter("__kept").select(*docs.columns)
