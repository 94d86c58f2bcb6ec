"""Multilayer perceptrons: Adam, training, forecasts over frames, and model files.

Training steps through the samples one at a time, which is serial by definition, so it runs
in numpy on bounded data on the driver, or once a group with :func:`fit_groups`.  Forecasts
run over any number of rows: the model is sent to executors once and applied in Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import autodiff as ad
from tessera.functions.rng import Rng


class Optimizer(Protocol):
    def step(self, parameter: np.ndarray, gradient: np.ndarray) -> None: ...


@dataclass
class Adam:
    """Bias-corrected Adam for one parameter, updated in place."""

    rate: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    t: int = 0
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0

    def step(self, parameter: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * gradient
        self.v = self.beta2 * self.v + (1 - self.beta2) * gradient * gradient
        m = self.m / (1 - self.beta1**self.t)
        v = self.v / (1 - self.beta2**self.t)
        parameter -= self.rate * m / (np.sqrt(v) + self.epsilon)


ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "identity": (ad.identity, lambda x: x),
    "tanh": (ad.tanh, np.tanh),
    "swish": (ad.swish, lambda x: x / (1 + np.exp(-x))),
}
CRITERIA = {"mse": ad.mean_squared_error, "squared": ad.squared_error, "huber": ad.huber_error, "logcosh": ad.logcosh_error}


@dataclass
class MLP:
    sizes: list[int]
    w: list[np.ndarray]
    b: list[np.ndarray]
    hidden: str = "tanh"
    out: str = "identity"

    @classmethod
    def init(cls, rng: Rng, sizes: Sequence[int], hidden: str = "tanh", out: str = "identity") -> MLP:
        """Glorot-uniform weights, zero biases."""
        w, b = [], []
        for a, c in zip(sizes, sizes[1:]):
            limit = math.sqrt(6 / (a + c))
            w.append(np.array([limit * (2 * rng.uniform() - 1) for _ in range(a * c)]).reshape(c, a))
            b.append(np.zeros((c, 1)))
        return cls(list(sizes), w, b, hidden, out)

    def _name(self, layer: int) -> str:
        return self.out if layer == len(self.w) - 1 else self.hidden

    def forward(self, tape: ad.Tape, x: np.ndarray) -> tuple[ad.Node, list[tuple[ad.Node, ad.Node]]]:
        """Output for one column and the parameter nodes."""
        a, nodes = tape.leaf(np.asarray(x, float).reshape(-1, 1)), []
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            nodes.append((tape.leaf(w), tape.leaf(b)))
            a = ACTIVATIONS[self._name(k)][0](ad.add(ad.matmul(nodes[-1][0], a), nodes[-1][1]))
        return a, nodes

    def forecast(self, x: np.ndarray) -> np.ndarray:
        """Outputs for samples in columns."""
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            x = ACTIVATIONS[self._name(k)][1](w @ x + b)
        return x

    def to_json(self) -> str:
        return json.dumps({"sizes": self.sizes, "layers": [{"W": w.tolist(), "b": b.ravel().tolist()} for w, b in zip(self.w, self.b)]}, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str, hidden: str = "tanh", out: str = "identity") -> MLP:
        """Activations are not part of the file."""
        d = json.loads(text)
        w = [np.array(x["W"], float).reshape(c, a) for x, a, c in zip(d["layers"], d["sizes"], d["sizes"][1:])]
        return cls([int(s) for s in d["sizes"]], w, [np.array(x["b"], float).reshape(-1, 1) for x in d["layers"]], hidden, out)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str, hidden: str = "tanh", out: str = "identity") -> MLP:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read(), hidden, out)


@dataclass
class Fit:
    model: MLP
    losses: list[float] = field(default_factory=list)  # mean loss of each epoch
    stopped: bool = False


def fit(
    x: np.ndarray,
    y: np.ndarray,
    sizes: Sequence[int],
    hidden: str = "tanh",
    out: str = "identity",
    criterion: str = "mse",
    epochs: int = 100,
    optimizer: Callable[[], Optimizer] = Adam,
    seed: int = 0,
    on_epoch: Callable[[int, float], bool] | None = None,
) -> Fit:
    """Stochastic gradient descent, one sample (column) a step in order; ``on_epoch`` may stop it by True."""
    model = MLP.init(Rng(seed, 0), sizes, hidden, out)
    steppers = [(optimizer(), optimizer()) for _ in model.w]
    result = Fit(model)
    for epoch in range(epochs):
        loss = 0.0
        for j in range(x.shape[1]):
            tape = ad.Tape()
            prediction, nodes = model.forward(tape, x[:, j])
            error = CRITERIA[criterion](prediction, tape.leaf(y[:, j : j + 1]))
            tape.backward(error)
            loss += error.value.item()
            for k, ((w, b), (sw, sb)) in enumerate(zip(nodes, steppers)):
                sw.step(model.w[k], w.grad)
                sb.step(model.b[k], b.grad)
        result.losses.append(loss / max(1, x.shape[1]))
        if on_epoch is not None and on_epoch(epoch, result.losses[-1]):
            result.stopped = True
            break
    return result


def fit_frame(df: DataFrame, xs: Sequence[str], ys: Sequence[str], order_by: str, sizes: Sequence[int], most_rows: int = 100_000, **options) -> Fit:
    """Fit on a frame of at most ``most_rows`` rows (it is gathered); more is an error."""
    rows = df.select(order_by, *xs, *ys).orderBy(order_by).limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"training gathers at most {most_rows} rows; fit on a sample or by groups")
    return fit(rows[list(xs)].to_numpy(float).T, rows[list(ys)].to_numpy(float).T, sizes, **options)


def fit_groups(df: DataFrame, by: Sequence[str], xs: Sequence[str], ys: Sequence[str], order_by: str, sizes: Sequence[int], **options) -> DataFrame:
    """One model a group, trained on executors: the group's columns, model (JSON) and last loss."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order_by)
        done = fit(rows[list(xs)].to_numpy(float).T, rows[list(ys)].to_numpy(float).T, sizes, **options)
        return pd.DataFrame([[*key, done.model.to_json(), done.losses[-1] if done.losses else math.nan]], columns=[*by, "model", "loss"])

    return df.groupBy(*by).applyInPandas(run, f"{kinds}, model string, loss double")


def forecast_frame(df: DataFrame, model: MLP, xs: Sequence[str], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Forecasts for every row, in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    picked = df.select(*keep, *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)])
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = sent.value.forecast(batch[[f"__x{i}" for i in range(len(xs))]].to_numpy(float).T)
            yield pd.concat([batch[list(keep)], pd.DataFrame(out.T, columns=list(names), index=batch.index)], axis=1)

    return picked.mapInPandas(run, ", ".join([*kept, *[f"{n} double" for n in names]]))
