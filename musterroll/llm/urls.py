"""URL filter: rules by host and path, and a linear model on hashed character n-grams for the rest.

DataFrame and SQL functions only; the model is the library's own logistic
regression, which is fitted on a bounded sample of labelled URLs.  The hosts of
a part of the sample are kept out of the fit, and the probability from which a
URL is blocked is the lowest that is precise enough on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import ascii_lower
from musterroll.runtime import written

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed values of the query's contract.
RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)

# Rules become one expression; longer lists belong in a table.
MAX_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one.

    A rule fits its host and all hosts below it, where the path begins with
    the rule's path.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"At most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, by_rule`` for every row."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.withColumn("by_rule", matching_rule(F.col("host"), F.col("path"), rules))


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5)  # characters of an n-gram
    features: int = 1 << 16
    sample: int = 20_000  # labelled URLs the model is fitted on, at most
    iterations: int = 30
    penalty: float = 1e-3
    held_out: int = 5  # one host in so many is kept out of the fit
    cuts: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)  # probabilities from which a URL may be blocked
    precision: float = 0.95  # share of the held-out URLs blocked that are rightly so


@dataclass(frozen=True)
class Fitted:
    """A model with its cut, and what it did with the hosts that it was not fitted on."""

    model: LogisticRegressionModel
    cut: float
    n_held_out: int = 0
    precision: float | None = None  # None where nothing held out was blocked
    recall: float | None = None


def _marked(grams: str, mark: str) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(mark), g))


def _with_features(parts: DataFrame, settings: Settings) -> DataFrame:
    """Hashed n-grams of ``host`` and ``path``; each part is marked and has its ends marked.

    The text is cut into characters once, so that long URLs take time in
    proportion to their length.
    """
    out = parts
    grams = []
    for part in ("host", "path"):
        chars = F.split(F.concat(F.lit("^"), F.col(part), F.lit("$")), "")
        out = out.withColumn(f"{part}_chars", F.filter(chars, lambda c: c != ""))
        for n in settings.sizes:
            name = f"{part}_{n}"
            out = NGram(n=n, inputCol=f"{part}_chars", outputCol=name).transform(out)
            grams.append(_marked(name, part[0]))
    out = out.withColumn("grams", F.concat(*grams))
    return HashingTF(numFeatures=settings.features, binary=True, inputCol="grams", outputCol="features").transform(out)


def sampled(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The labelled rows with the smallest hashes of host and path, one for each host and path.

    So the sample doesn't depend on how rows are dealt out, and a host with many
    copies of a URL weighs no more than others; a URL with both labels is to be
    blocked.  An estimate of the number of URLs gives a bound of the hashes that
    are needed, and no other row is shuffled.  Should the estimate have been too
    low, all rows are.
    """
    keyed = labelled.select("host", "path", F.col("label").cast("double").alias("label"), F.xxhash64("host", "path").alias("at"))
    urls = keyed.agg(F.approx_count_distinct("at")).first()[0]
    share = 2 * settings.sample / max(urls, 1)

    def smallest(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("host", "path").agg(F.max("label").alias("label"), F.first("at").alias("at"))
        return written(each.orderBy("at", "host", "path").limit(settings.sample), "url-sample")

    if share >= 1:
        return smallest(keyed)
    sample = smallest(keyed.filter(F.col("at") <= int(share * (1 << 64)) - (1 << 63)))
    return sample if sample.count() == settings.sample else smallest(keyed)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Fitted | None:
    """Model from ``host, path, label`` (1 for block); None without any labelled row.

    Both labels weigh the same in the fit, however rare one is.  Where the hosts
    that are not held out lack a label, all are used, nothing is measured, and
    the lowest cut is taken.
    """
    held = F.pmod(F.xxhash64(F.lit("held out"), "host"), F.lit(settings.held_out)) == 0
    sample = sampled(labelled, settings).withColumn("held", held)
    counts = {(r.held, r.label): r["count"] for r in sample.groupBy("held", "label").count().collect()}
    if not counts:
        return None
    measured = all(counts.get((False, label)) for _, label in counts)
    used = {label: sum(n for (out, other), n in counts.items() if other == label and not (measured and out)) for _, label in counts}
    weight = F.lit(0.0)
    for label, n in used.items():
        weight = F.when(F.col("label") == label, sum(used.values()) / len(used) / n).otherwise(weight)
    seen = sample.filter(~F.col("held")) if measured else sample
    ready = _with_features(seen.withColumn("weight", weight), settings).select("features", "label", "weight")
    learner = LogisticRegression(maxIter=settings.iterations, regParam=settings.penalty, standardization=False, weightCol="weight")
    model = learner.fit(ready)
    return _with_cut(model, sample.filter("held"), settings) if measured else Fitted(model, settings.cuts[0])


def _with_cut(model: LogisticRegressionModel, held: DataFrame, settings: Settings) -> Fitted:
    """The lowest cut that is precise enough on URLs of other hosts, else the highest."""
    scored = blocked_share(held, Fitted(model, settings.cuts[0]), settings)
    bad = F.col("label") == 1
    counts = [[F.count_if(F.col("score") >= c), F.count_if((F.col("score") >= c) & bad)] for c in settings.cuts]
    n, n_bad, *found = scored.agg(F.count("*"), F.count_if(bad), *[c for pair in counts for c in pair]).first()
    blocked, right = found[::2], found[1::2]
    good = [i for i, b in enumerate(blocked) if b and right[i] / b >= settings.precision]
    best = good[0] if good else len(blocked) - 1 if any(blocked) else 0
    precision = right[best] / blocked[best] if blocked[best] else None
    return Fitted(model, settings.cuts[best], n, precision, right[best] / n_bad if n_bad else None)


def blocked_share(parts: DataFrame, fitted: Fitted | None, settings: Settings = Settings()) -> DataFrame:
    """Adds ``score``, the model's probability of block; 0 without a model."""
    if fitted is None:
        return parts.withColumn("score", F.lit(0.0))
    kept = parts.columns
    scored = fitted.model.transform(_with_features(parts, settings))
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*kept, F.coalesce(chance, F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings(), labelled: DataFrame | None = None) -> DataFrame:
    """Verdict on every page's URL: the rule's, else the model's.

    Without ``labelled`` (``url, label``, where 1 is block) the URLs that a
    rule decides serve as the labelled table; a model of these knows no more
    than the rules, so give a table of your own where there is one.  ``cut`` is
    the score from which the model blocks, and ``held_out_precision`` the share
    of URLs rightly blocked among the labelled ones that it was not fitted on
    (null where none was blocked).  Null and broken URLs have an
    empty host and path and go to the model; rows with equal ids are judged one
    by one.  If there is nothing to learn from, every other URL is allowed.
    """
    parts = judged_by_rules(pages, rules)
    if labelled is None:
        seen = parts.filter(F.col("by_rule").isNotNull())
        known = seen.select("host", "path", (F.col("by_rule.verdict") == BLOCK).cast("int").alias("label"))
    else:
        host, path = host_and_path(F.col("url"))
        known = labelled.filter(F.col("label").isNotNull()).select(host.alias("host"), path.alias("path"), "label")
    fitted = fit(known, settings)
    scored = blocked_share(parts, fitted, settings)
    cut = fitted.cut if fitted else settings.cuts[0]
    learnt = F.when(F.col("score") >= cut, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        F.coalesce(F.col("by_rule.verdict"), learnt).alias("verdict"),
        "score",
        F.lit(cut).alias("cut"),
        F.lit(fitted and fitted.precision).cast("double").alias("held_out_precision"),
    )
