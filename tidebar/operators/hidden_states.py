"""Hidden Markov states with Gaussian emissions over many series.

One model is shared by all series; every ticker is a sequence of its own. Expectation maximisation runs as a loop of Spark jobs:
each task reads its tickers in date order, folds them forward and backward with scaled probabilities, all sequences of a
buffer step by step together, and gives out expected counts only. Spark sums these, and the driver turns the sums, some
``k * k + k * d * d`` numbers, into the next parameters. The prepared rows are checkpointed once, placed by ticker and sorted.
States of a fitted model are decoded by the Viterbi recursion in one more pass.

A ticker has one row per date, so its length is bounded by the calendar; a task holds one ticker or some tens of thousands
of rows, whichever is more. Rows with a null feature are left out of fit and result. Ties go to the state that comes first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import pinned

HELD = 50_000


def _whole_tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that split no ticker."""
    held, rows, limit = [], 0, HELD
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = pc.index(t["ticker"], t["ticker"][-1]).as_py()
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            rows -= cut
            limit = max(HELD, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _borders(t: pa.Table) -> np.ndarray:
    names = t["ticker"].combine_chunks()
    new = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(names)]])


class _Steps:
    """Sequences ordered by falling length, so that those that go on at step t are the first ``active[t]``."""

    def __init__(self, borders: np.ndarray):
        sizes = np.diff(borders)
        order = np.argsort(-sizes, kind="stable")
        self.begin, self.sizes = borders[:-1][order], sizes[order]
        self.longest = int(self.sizes[0])
        self.active = np.searchsorted(-self.sizes, -np.arange(1, self.longest + 1), "right")

    def at(self, t: int) -> np.ndarray:
        return self.begin[:self.active[t]] + t


@dataclass
class HiddenStates:
    """A fitted model: scaling of the features, start and step probabilities, means and covariances of the scaled features."""

    features: list[str]
    centre: np.ndarray
    width: np.ndarray
    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    history: list[float] = field(default_factory=list)

    # ---- numbers of a buffer of sequences ----

    def _scaled(self, t: pa.Table) -> np.ndarray:
        x = np.stack([t[k].combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64) for k in self.features], 1)
        return (x - self.centre) / self.width

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.mean)))
        for k, (m, cov) in enumerate(zip(self.mean, self.cov)):
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def _forward(self, dens: np.ndarray, s: _Steps) -> tuple[np.ndarray, np.ndarray]:
        ahead, scale = np.empty_like(dens), np.empty(len(dens))
        for t in range(s.longest):
            at = s.at(t)
            a = dens[at] * (self.start if t == 0 else ahead[at - 1] @ self.step)
            scale[at] = np.maximum(a.sum(1), 1e-300)
            ahead[at] = a / scale[at, None]
        return ahead, scale

    def posterior(self, x: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """State probabilities per row, expected steps between states, and the log likelihood."""
        logs = self.log_density(x)
        top = logs.max(1)
        dens, s = np.exp(logs - top[:, None]), _Steps(borders)
        ahead, scale = self._forward(dens, s)
        behind, steps = np.ones_like(dens), np.zeros_like(self.step)
        for t in range(s.longest - 1, 0, -1):
            at = s.at(t)
            onward = dens[at] * behind[at] / scale[at, None]
            steps += self.step * (ahead[at - 1].T @ onward)
            behind[at - 1] = onward @ self.step.T
        p = ahead * behind
        return p / p.sum(1, keepdims=True), steps, float((np.log(scale) + top).sum())

    def viterbi(self, x: np.ndarray, borders: np.ndarray) -> np.ndarray:
        logs, s = self.log_density(x), _Steps(borders)
        with np.errstate(divide="ignore"):
            start, step = np.log(self.start), np.log(self.step)
        best, back = logs.copy(), np.zeros(logs.shape, np.int8)
        for t in range(s.longest):
            at = s.at(t)
            if t == 0:
                best[at] += start
            else:
                ways = best[at - 1][:, :, None] + step
                back[at] = ways.argmax(1)
                best[at] += ways.max(1)
        states = np.empty(len(x), np.int64)
        for t in range(s.longest - 1, -1, -1):
            at = s.at(t)
            ends = s.sizes[:len(at)] == t + 1
            states[at[ends]] = best[at[ends]].argmax(1)
            on = at[~ends]
            states[on] = back[on + 1, states[on + 1]]
        return states

    # ---- fit ----

    def _sums(self, x: np.ndarray, borders: np.ndarray) -> np.ndarray:
        p, steps, likelihood = self.posterior(x, borders)
        second = np.einsum("nk,ni,nj->kij", p, x, x)
        return np.concatenate([[likelihood, len(x)], p[borders[:-1]].sum(0), steps.ravel(), p.sum(0), (p.T @ x).ravel(), second.ravel()])

    def _updated(self, sums: np.ndarray, floor: float) -> HiddenStates:
        k, d = self.mean.shape
        start, steps, weight, first, second = np.split(sums[2:], np.cumsum([k, k * k, k, k * d]))
        weight = np.maximum(weight, 1e-12)
        mean = first.reshape(k, d) / weight[:, None]
        cov = second.reshape(k, d, d) / weight[:, None, None] - np.einsum("ki,kj->kij", mean, mean) + floor * np.eye(d)
        steps = steps.reshape(k, k)
        rows = steps.sum(1, keepdims=True)
        step = np.where(rows > 0, steps / np.maximum(rows, 1e-300), 1 / k)
        return HiddenStates(self.features, self.centre, self.width, start / start.sum(), step, mean, cov, self.history)

    # ---- use ----

    def ordered_by(self, feature: int) -> HiddenStates:
        """The same model, its states by falling mean of a feature."""
        o = np.argsort(-self.mean[:, feature], kind="stable")
        return HiddenStates(self.features, self.centre, self.width, self.start[o], self.step[np.ix_(o, o)], self.mean[o], self.cov[o], self.history)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``state`` (the likeliest path) and ``probs`` (of each state, given the whole series) to rows without nulls."""
        schema = df.dropna(subset=self.features).schema.add("state", T.IntegerType()).add("probs", T.ArrayType(T.DoubleType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole_tickers(batches):
                x, borders = self._scaled(t), _borders(t)
                p = self.posterior(x, borders)[0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                out = t.append_column("state", pa.array(self.viterbi(x, borders).astype(np.int32))).append_column("probs", lists)
                yield from out.to_batches(10_000)

        return prepared(df, self.features).mapInArrow(run, schema)

    def to_json(self) -> str:
        arrays = {k: getattr(self, k).tolist() for k in ("centre", "width", "start", "step", "mean", "cov")}
        return json.dumps({"features": self.features, "history": self.history, **arrays})

    @staticmethod
    def from_json(text: str) -> HiddenStates:
        d = json.loads(text)
        return HiddenStates(d["features"], *[np.array(d[k]) for k in ("centre", "width", "start", "step", "mean", "cov")], history=d["history"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> HiddenStates:
        return HiddenStates.from_json(spark.read.option("wholetext", True).text(path).first()["value"])


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows without null features, placed by ticker and in date order."""
    return df.dropna(subset=["ticker", *features]).repartition("ticker").sortWithinPartitions("ticker", "date")


def _first_guess(df: DataFrame, features: list[str], n_states: int) -> HiddenStates:
    """Scaling by all rows; each state starts as a slice of the first feature between its quantiles."""
    stats = df.agg(*[f(k).alias(f"{n}_{i}") for i, k in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre = np.array([stats[f"m_{i}"] for i in range(len(features))], float)
    width = np.array([stats[f"s_{i}"] for i in range(len(features))], float)
    width = np.where(width > 1e-12, width, 1.0)
    cuts = [-np.inf, *df.approxQuantile(features[0], [i / n_states for i in range(1, n_states)], 0.001), np.inf]
    part = sum((F.when(F.col(features[0]) > float(cut), 1).otherwise(0) for cut in cuts[1:-1]), F.lit(0))
    rows = df.groupBy(part.alias("part")).agg(*[F.avg(k).alias(k) for k in features]).collect()
    mean = np.zeros((n_states, len(features)))
    for r in rows:
        mean[r["part"]] = (np.array([r[k] for k in features], float) - centre) / width
    stay = 0.9 if n_states > 1 else 1.0
    step = np.full((n_states, n_states), (1 - stay) / max(n_states - 1, 1))
    np.fill_diagonal(step, stay)
    return HiddenStates(features, centre, width, np.full(n_states, 1 / n_states), step, mean, np.tile(np.eye(len(features)), (n_states, 1, 1)))


def fit_hidden_states(df: DataFrame, features: list[str], n_states: int = 3, max_iter: int = 75, tol: float = 1e-6, floor: float = 1e-6) -> HiddenStates:
    """Fit by expectation maximisation until the log likelihood per row gains less than ``tol``. Jobs run when this is called.

    ``history`` of the result holds the log likelihood before each update.
    """
    d = pinned(prepared(df.select("ticker", "date", *[F.col(k).cast("double").alias(k) for k in features]), features))
    if not d.head(1):
        raise ValueError("no rows without nulls to fit on")
    model = _first_guess(d, features, n_states)
    d = d.select("ticker", *features)
    for _ in range(max_iter):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: HiddenStates = now) -> Iterator[pa.RecordBatch]:
            for t in _whole_tickers(batches):
                sums = now._sums(now._scaled(t), _borders(t))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["i", "x"])

        rows = d.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        sums = np.array([r["x"] for r in sorted(rows, key=lambda r: r["i"])])
        model.history.append(float(sums[0]))
        if len(model.history) > 1 and model.history[-1] - model.history[-2] < tol * sums[1]:
            break
        model = model._updated(sums, floor)
    return model
