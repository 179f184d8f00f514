"""Soft-membership mixing: document rates whose expected domain totals match targets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import columns_of, filled, free_name, table, words
from newswake.session import written

#: Target shares of the tokens by domain.
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}
MAX_TRAINING = 8_000  # labelled documents that the classifier is fitted on
MAX_MARKS = 150  # marks with the strongest link to a domain that the classifier uses
MIN_STRENGTH = 25.0  # chi-square of a mark: weaker links are chance among so many words
MIN_LIFT = 2.0  # times that a mark is more frequent in some domain than in all: frequent words of one language are none
STEPS = 25
TOLERANCE = 1e-3  # of all tokens
SEED = "mix-1"


def label_domain() -> Column:
    """The domain that the labels of a document give."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def _marks(w: Column, text: Column) -> Column:
    """What the classifier sees of a document: its different words, and some traits of the whole text."""
    n = F.size(w)
    size = F.length(text)
    traits = F.array(
        F.when(n < 50, " short"), F.when(2 * F.size(F.array_distinct(w)) < n, " repeating"),
        F.when(10 * F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > 3 * size, " upper"),
        F.when(50 * F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")) > size, " symbols"),
        F.when(F.contains(text, F.lit("|")), " bars"))
    return F.concat(F.transform(w, F.lower), F.array_compact(traits))


@dataclass
class Domains:
    """Names, log-odds at no mark, and what each mark adds: a naive Bayes model over marks."""

    names: list[str]
    base: list[float]
    marks: list[str]
    weights: list[list[float]]


def fit(docs: DataFrame, labels: DataFrame, names: list[str], max_rows: int = MAX_TRAINING, max_marks: int = MAX_MARKS) -> Domains:
    """Fit on the ``max_rows`` labelled documents with the smallest hash of their id (their ids and domains are broadcast).

    Bernoulli naive Bayes with add-one smoothing. The marks are those whose
    counts deviate most from independence of the domain (chi-square of at
    least ``MIN_STRENGTH``, ties by name) and that are ``MIN_LIFT`` times as
    frequent in some domain as in all. Nothing labelled gives no marks and equal posteriors.
    """
    known = labels.select("doc_id", label_domain().alias("domain")).filter(F.col("domain").isin(names) & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", filled(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    seen = written(rows.select("domain", F.array_distinct(_marks(words(F.col("text")), F.col("text"))).alias("marks")), "marks")
    sizes = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in names]
    total = sum(n)
    if not total:
        return Domains(names, [0.0] * len(names), [], [])
    counted = seen.select("domain", F.explode("marks").alias("mark")).groupBy("mark").agg(
        *[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(names)])
    whole = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0))
    usual = [whole * (n[k] / total) for k in range(len(names))]
    strength = sum((F.pow(F.col(f"n{k}") - usual[k], 2) / (usual[k] + 1) for k in range(len(names))), F.lit(0.0))
    lift = F.greatest(*[F.col(f"n{k}") * (total / max(n[k], 1)) / whole for k in range(len(names))], F.lit(0.0))
    top = counted.filter((whole >= 5) & (strength >= MIN_STRENGTH) & (lift >= MIN_LIFT)).orderBy(F.desc(F.round(strength, 6)), "mark").limit(max_marks).collect()
    base = np.log([(x + 1) / (total + len(names)) for x in n])
    weights = []
    for r in top:
        p = np.array([(r[f"n{k}"] + 1) / (n[k] + 2) for k in range(len(names))])
        base = base + np.log(1 - p)
        weights.append((np.log(p) - np.log(1 - p)).tolist())
    return Domains(names, base.tolist(), [r.mark for r in top], weights)


def with_posteriors(df: DataFrame, words: Column, text: Column, model: Domains, name: str) -> DataFrame:
    """Adds the posterior of each domain, an array in the order of the names.

    Each step is a column, so that no step is computed again inside the next.
    """
    present, scores, odds = (free_name(df, f"_{name}_{x}") for x in ("present", "scores", "odds"))

    def score(k: int) -> Column:
        if not model.marks:
            return F.lit(model.base[k])
        own = F.lit([x[k] for x in model.weights])
        return F.aggregate(present, F.lit(model.base[k]), lambda s, i: s + F.element_at(own, i.cast("int")))

    if model.marks:
        found = F.array_intersect(_marks(words, text), F.lit(model.marks))
        df = df.withColumn(present, F.transform(found, lambda x: F.array_position(F.lit(model.marks), x)))
    df = df.withColumn(scores, F.array(*map(score, range(len(model.names)))))
    top = F.array_max(scores)
    df = df.withColumn(odds, F.array(*[F.exp(F.col(scores)[k] - top) for k in range(len(model.names))]))
    mass = sum((F.col(odds)[k] for k in range(len(model.names))), F.lit(0.0))
    return df.withColumn(name, F.array(*[F.col(odds)[k] / mass for k in range(len(model.names))])).drop(present, scores, odds)


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate that the projected steps lead to, from 1: each takes ``p . y`` off, and never goes below 0."""
    r = F.lit(1.0)
    for y in steps:
        r = F.greatest(r - sum((p[k] * y[k] for k in range(1, len(y))), p[0] * y[0]), F.lit(0.0))
    return r


def solve(members: DataFrame, targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The steps of a projected gradient descent for the rates of ``members`` (``n_tokens``, ``p``).

    Minimised is the squared difference between the expected tokens of the
    domains, sum of rate * n_tokens * p, and their targets, scaled by the
    inverse of sum of n_tokens * p p'. In the metric that weighs a rate by
    its document's tokens the gradient of a document is p . y, with one
    vector y for all: so a step is a few numbers, and the rates never have to
    be stored. A step is scaled by the sum over the rows whose rate is not yet
    0; one that raises the loss is taken back and made shorter. Each round is
    one sum over the rows. It ends at ``steps``, at the tolerance, or when a
    round gains next to nothing.
    """
    d = len(targets)
    token, p = F.col("n_tokens").cast("double"), F.col("p")
    upper = [(i, j) for i in range(d) for j in range(i + 1)]
    shares = np.array(list(targets.values()), float)

    def sums(taken: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, expected tokens of the domains, and the matrix over the rows whose rate can still fall."""
        rows = members.select(token.alias("t"), "p", rate(p, taken).alias("r"))
        open_ = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = rows.agg(
            F.sum("t"), *[F.sum(F.col("r") * F.col("t") * p[k]) for k in range(d)], *[F.sum(open_ * p[i] * p[j]) for i, j in upper]).first()
        matrix = np.zeros((d, d))
        for (i, j), x in zip(upper, got[1 + d:], strict=True):
            matrix[i, j] = matrix[j, i] = x or 0.0
        return got[0] or 0.0, np.array([x or 0.0 for x in got[1:1 + d]]), matrix

    total, got, whole = sums([])
    if not total:
        return []
    wanted = shares / shares.sum() * total
    ridge = 1e-9 * total * np.eye(d)
    taken: list[list[float]] = []
    scaled = np.linalg.pinv(whole + ridge)
    matrix, length, last = whole, 1.0, np.inf
    for _ in range(steps):
        off = got - wanted
        loss = float(off @ scaled @ off) / total
        if loss > last:  # the step went too far: take it back, and go on with a shorter one
            taken.pop()
            length /= 4
            _, got, matrix = sums(taken)
            off = got - wanted
        else:
            if np.abs(off).max() / total <= tolerance or last - loss < tolerance ** 2:
                return taken
            length, last = min(1.0, 2 * length), loss
        taken.append((length * (np.linalg.pinv(matrix + ridge) @ off)).tolist())
        _, got, matrix = sums(taken)
    off = got - wanted
    return taken[:-1] if float(off @ scaled @ off) / total > last else taken


def plan(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS,
    max_rows: int = MAX_TRAINING, max_marks: int = MAX_MARKS,
) -> tuple[Domains, list[list[float]], DataFrame]:
    """The fitted classifier, the steps, and (doc_id, n_tokens, p) of every row.

    Null texts have no tokens, and still a posterior and rate. Rows are independent: repeated rows and
    null ids count like others. An empty table leaves no steps; without labels all domains are equally likely.
    """
    model = fit(docs, labels, list(targets), max_rows, max_marks)
    rows = docs.select("doc_id", filled(F.col("text")).alias("text"), words(F.col("text")).alias("w"))
    rows = with_posteriors(rows, F.col("w"), F.col("text"), model, "p")
    members = written(rows.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), "p"), "members")
    return model, solve(members, targets, steps), members


def copies(rate: Column, id: Column, seed: str = SEED) -> Column:
    """A whole number of copies with the rate as its expectation: seeded by the id, the same in every run."""
    draw = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 20)) / (1 << 20)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, seed: str = SEED) -> DataFrame:
    """The documents at their rates: none, one or more equal rows each. Computed in the scan, without a shuffle."""
    model, steps, _ = plan(docs, labels, targets)
    name, w, p = (free_name(docs, x) for x in ("copy", "words", "posterior"))
    rows = with_posteriors(docs.withColumn(w, words(F.col("text"))), F.col(w), filled(F.col("text")), model, p)
    n = copies(rate(F.col(p), steps), F.col("doc_id"), seed)
    return rows.withColumn(name, F.explode(F.array_repeat(F.lit(0), n))).select(*columns_of(docs))


def op1_soft_mixture(spark, sf_dir: str) -> DataFrame:
    _, steps, members = plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    r = rate(F.col("p"), steps)
    return members.select(
        "doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(TARGETS)], r.alias("rate"),
        copies(r, F.col("doc_id")).alias("copies"))
