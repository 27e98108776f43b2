"""Mixing documents to target weights of domains, with built-in functions only.

A classifier fitted on labelled rows gives every document posteriors of the domains. Projected gradient steps of a
least-squares problem then find nonnegative rates for the documents, such that the expected tokens of each domain,
summed over documents (rate * tokens * posterior), meet the targets. A step moves a document's rate along its
posteriors, so a step is as many numbers as there are domains, and each step needs one aggregation over the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, shared_dir, text_of

#: Domains in the order of the classifier's classes, with their default shares of the output's tokens.
TARGETS = {"high": 0.85, "low": 0.13, "toxic": 0.02}
#: Tokens of the output by those of the input.
BUDGET = 1.15
#: Bound of the labelled rows that the classifier is fitted on: those of least hash.
TRAIN_ROWS = 20_000
WORD_BUCKETS, SHAPE_BUCKETS = 4_096, 64
#: A bucket counts only if its frequency in a domain is that many standard errors off.
LEAST_Z = 4.0
MAX_STEPS = 30
TOLERANCE = 1e-6


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")


def buckets(found: Column) -> Column:
    """The distinct hash buckets of words and of their last characters."""
    whole = F.transform(found, lambda x: F.pmod(F.xxhash64(x), F.lit(WORD_BUCKETS)).cast("int"))
    last = F.transform(found, lambda x: (F.pmod(F.xxhash64(F.right(x, F.lit(1))), F.lit(SHAPE_BUCKETS)) + WORD_BUCKETS).cast("int"))
    return F.array_distinct(F.concat(whole, last))


@dataclass(frozen=True)
class Classifier:
    """Log prior and log-likelihood weights of each domain, relative to the first domain."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def with_posteriors(self, rows: DataFrame, found: str) -> DataFrame:
        """rows, whose column found has a document's buckets, with p_<domain> in its place.

        Each domain's weights stand once in the plan: the sums are columns before anything is made of them.
        """
        others = [c for c in rows.columns if c != found]

        def log_odds(prior: float, weights: tuple[float, ...]) -> Column:
            table = F.from_json(F.lit("[" + ",".join(f"{w:.6g}" for w in weights) + "]"), "array<double>")
            return F.aggregate(found, F.lit(prior), lambda s, i: s + F.get(table, i))

        logs = [F.lit(0.0), *map(log_odds, self.prior[1:], self.weights[1:])]
        rows = rows.select(*others, *(x.alias(f"l_{d}") for x, d in zip(logs, self.domains, strict=True)))
        top = F.greatest(*(f"l_{d}" for d in self.domains)) if len(self.domains) > 1 else F.col(f"l_{self.domains[0]}")
        rows = rows.select(*others, *(F.exp(F.col(f"l_{d}") - top).alias(f"o_{d}") for d in self.domains))
        total = sum((F.col(f"o_{d}") for d in self.domains[1:]), F.col(f"o_{self.domains[0]}"))
        return rows.select(*others, *((F.col(f"o_{d}") / total).alias(f"p_{d}") for d in self.domains))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = tuple(TARGETS), train_rows: int = TRAIN_ROWS) -> Classifier:
    """Naive Bayes over bucket presence, fitted on at most train_rows labelled documents.

    A document is toxic if any of its label rows says so, else low if any says quality 0, else high; label rows
    with nulls are ignored. Without labels all domains are equally likely.
    """
    one = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    one = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    sample = one.select("doc_id", kind.alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(sample), "doc_id")  # train_rows rows of 12 bytes
    seen = rows.select("kind", F.explode(F.concat(F.array(F.lit(-1)), buckets(words(F.col("text"))))).alias("bucket"))
    counts = np.zeros((len(domains), WORD_BUCKETS + SHAPE_BUCKETS + 1))
    for r in seen.groupBy("kind", "bucket").count().collect():  # domains x buckets rows at most
        counts[r["kind"], r["bucket"]] = r["count"]
    n, counts = counts[:, -1], counts[:, :-1]
    share = (counts + 0.5) / (n[:, None] + 1)
    rest = (counts.sum(0) - counts + 0.5) / (n.sum() - n[:, None] + 1)
    both = (counts.sum(0) + 0.5) / (n.sum() + 1)
    error = np.sqrt(both * (1 - both) * (1 / (n[:, None] + 1) + 1 / (n.sum() - n[:, None] + 1)))
    logs = np.where(np.abs(share - rest) >= LEAST_Z * error, np.log(share / rest), 0.0)
    prior = np.log((n + 1) / (n.sum() + len(domains)))
    return Classifier(domains, tuple(prior - prior[0]), tuple(map(tuple, logs - logs[0])))


@dataclass(frozen=True)
class Rates:
    """Fitted steps: the rate of a document is found from its posteriors alone."""

    steps: tuple[tuple[float, ...], ...]
    shortfall: float

    def of(self, posteriors: list[Column]) -> Column:
        rate: Column = F.lit(1.0)
        for step in self.steps:
            move = sum((p * s for p, s in zip(posteriors[1:], step[1:], strict=True)), posteriors[0] * step[0])
            rate = F.greatest(F.lit(0.0), rate - move)
        return rate


def fit_rates(scored: DataFrame, domains: tuple[str, ...], targets: dict[str, float], budget: float) -> Rates:
    """Least squares over scored (n_tokens, p_<domain>), by projected gradient steps from rate 1.

    The gradient is scaled by the inverse of the domains' co-occurrence among documents whose rate is not at 0.
    """
    p = [F.col(f"p_{d}") for d in domains]
    k = len(domains)
    steps: list[tuple[float, ...]] = []
    best: tuple[float, int] = (float("inf"), 0)
    want = None
    for _ in range(MAX_STEPS):
        rated = scored.select("n_tokens", *p, Rates(tuple(steps), 0.0).of(p).alias("rate"))
        free = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(0)
        sums = [F.sum("n_tokens").alias("n"), *(F.sum(F.col("rate") * F.col("n_tokens") * x).alias(f"m{i}") for i, x in enumerate(p))]
        sums += [F.sum(free * p[i] * p[j]).alias(f"h{i}{j}") for i in range(k) for j in range(i, k)]
        got = rated.agg(*sums).first()
        total = got["n"] or 0
        if total == 0:
            return Rates((), 0.0)
        if want is None:
            share = np.array([targets[d] for d in domains], float)
            want = share / share.sum() * budget * total
        gap = np.array([got[f"m{i}"] for i in range(k)]) - want
        size = float(np.abs(gap).sum() / want.sum())
        if size < best[0]:
            best = (size, len(steps))
        if size < TOLERANCE:
            break
        h = np.array([[got[f"h{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
        steps.append(tuple(float(x) for x in np.linalg.solve(h + 1e-9 * total * np.eye(k), gap)))
    return Rates(tuple(steps[: best[1]]), best[0])


def copies(rate: Column, doc_id: Column) -> Column:
    """The rate rounded to whole copies, up or down by a hash of doc_id so that sums hold."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + chance).cast("long")


@dataclass(frozen=True)
class Mix:
    """A fitted mix; scored is a written table of doc (a struct of kept columns), n_tokens and p_<domain>."""

    classifier: Classifier
    rates: Rates
    scored: DataFrame

    def rated(self) -> DataFrame:
        """scored with each document's rate and its whole copies."""
        chances = [F.col(f"p_{d}") for d in self.classifier.domains]
        out = self.scored.withColumn("rate", self.rates.of(chances))
        return out.withColumn("copies", copies(F.col("rate"), F.col("doc.doc_id")))


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> Mix:
    """Fit classifier and rates. One pass over the texts writes the posteriors, with the columns keep (doc_id among
    them) beside them, so that neither the fitting steps nor the mixing read the texts' words again."""
    folder = shared_dir(docs.sparkSession)
    domains = tuple(targets)
    classifier = fit_classifier(docs, labels, domains, train_rows)
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("doc"), words(text_of(docs)).alias("words"))
    rows = rows.select("doc", F.size("words").cast("long").alias("n_tokens"), buckets(F.col("words")).alias("found"))
    scored = materialize(classifier.with_posteriors(rows, "found"), folder, "scored")
    return Mix(classifier, fit_rates(scored, domains, targets, budget), scored)


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """Rates of all documents: doc_id, n_tokens, p_<domain>, rate, copies, shortfall.

    shortfall is the same in all rows: what the fitted rates leave of the targets, summed over the domains, by the
    targets' sum. Null text is an empty text, without tokens, judged by the prior; a null doc_id is an id of its own.
    Repeated rows are rows of their own, all with the same rate and copies; further columns are ignored; empty
    tables give no rows. If the targets can't be met, the nearest rates found stand.
    """
    fitted = fit(docs, labels, targets, budget)
    chances = [f"p_{d}" for d in fitted.classifier.domains]
    return fitted.rated().select("doc.doc_id", "n_tokens", *chances, "rate", "copies", F.lit(fitted.rates.shortfall).alias("shortfall"))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """Each document as often as its rate says, with the columns of docs, whatever their names; rows as mix_documents'."""
    rated = fit(docs, labels, targets, budget, keep=tuple(docs.columns)).rated().filter("copies > 0")
    repeated = rated.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.select("doc.*")
