"""Small neural networks on tables: scoring, comparing, fitting."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scaling import percent_error
from tessera.functions.state import entropic_state, inverse_log_targets
from tessera.operators.sequence import index_rows
from tessera.operators.stats import exact_quantiles, mse, r2
from tessera.runtime import cut_lineage

def _erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


# name -> (value, slope)
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda x: x, np.ones_like),
    "elu": (lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
            lambda x: np.where(x > 0, 1.0, np.exp(np.minimum(x, 0)))),
    "relu": (lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(float)),
    "tanh": (np.tanh, lambda x: 1 - np.tanh(x) ** 2),
    "exponential": (np.exp, np.exp),
    "gelu": (lambda x: 0.5 * x * (1 + _erf(x / math.sqrt(2))),
             lambda x: 0.5 * (1 + _erf(x / math.sqrt(2))) + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)),
    "sigmoid": (_sigmoid, lambda x: _sigmoid(x) * (1 - _sigmoid(x))),
    "swish": (lambda x: x * _sigmoid(x), lambda x: _sigmoid(x) * (1 + x * (1 - _sigmoid(x)))),
}

# the same as column expressions; gelu needs erf, which Spark lacks
COLUMN_ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: x,
    "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": F.tanh,
    "exponential": F.exp,
    "sigmoid": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
    "swish": lambda x: x / (F.lit(1.0) + F.exp(-x)),
}


@dataclass
class Network:
    """Weights (inputs x outputs per layer), biases, activation and the scaler pairs."""

    inputs: list[str]
    outputs: list[str]
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activation: str = "tanh"
    x_scaler: list[tuple[float, float]] = field(default_factory=list)
    y_scaler: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.x_scaler = self.x_scaler or [(0.0, 1.0)] * len(self.inputs)
        self.y_scaler = self.y_scaler or [(0.0, 1.0)] * len(self.outputs)

    @property
    def cost(self) -> int:
        """Sum over layers of rows x columns."""
        return int(sum(w.size for w in self.weights))

    def predict(self, x: np.ndarray) -> np.ndarray:
        phi = ACTIVATIONS[self.activation][0]
        o, s = np.array(self.x_scaler).T
        y = (x - o) / s
        for w, b in zip(self.weights[:-1], self.biases[:-1]):
            y = phi(y @ w + b)
        y = y @ self.weights[-1] + self.biases[-1]
        o, s = np.array(self.y_scaler).T
        return y * s + o


def mlp_score(df: DataFrame, net: Network, prefix: str = "pred_", inverse: dict[str, Column] | None = None) -> DataFrame:
    """Add the network outputs. Only the input columns travel to Python, in Arrow batches."""
    names = [prefix + o for o in net.outputs]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def predict(*x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(net.predict(np.column_stack([c.to_numpy(dtype=float) for c in x])), columns=names)

    out = df.withColumn("_out", predict(*[F.col(c) for c in net.inputs]))
    out = out.select(*df.columns, *[F.col("_out")[n].alias(n) for n in names])
    return out.withColumns(inverse) if inverse else out


def mlp_score_columns(df: DataFrame, net: Network, prefix: str = "pred_") -> DataFrame:
    """The same as column expressions, for small networks: one projection per layer, no Python."""
    phi = COLUMN_ACTIVATIONS[net.activation]
    keep = df.columns
    df = df.withColumns({f"_h0_{i}": (F.col(c) - F.lit(o)) / F.lit(s)
                         for i, (c, (o, s)) in enumerate(zip(net.inputs, net.x_scaler))})
    for layer, (w, b) in enumerate(zip(net.weights, net.biases)):
        last = layer == len(net.weights) - 1
        cols = {}
        for j in range(w.shape[1]):
            z = reduce(lambda a, t: a + t, [F.col(f"_h{layer}_{i}") * F.lit(float(w[i, j])) for i in range(w.shape[0])])
            z = z + F.lit(float(b[j]))
            cols[f"_h{layer + 1}_{j}"] = z if last else phi(z)
        df = df.withColumns(cols)
    n = len(net.weights)
    return df.select(*keep, *[(F.col(f"_h{n}_{j}") * F.lit(s) + F.lit(o)).alias(prefix + out)
                              for j, (out, (o, s)) in enumerate(zip(net.outputs, net.y_scaler))])


def mlp_score_many(df: DataFrame, nets: dict[int, Network], score: str = "mse") -> DataFrame:
    """Scaled test error of every network of a population, in one scan: ``(net_id, mse)``."""
    any_net = next(iter(nets.values()))
    inputs, outputs = any_net.inputs, any_net.outputs

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = dict.fromkeys(nets, 0.0)
        n = 0
        for pdf in batches:
            x, y = pdf[inputs].to_numpy(dtype=float), pdf[outputs].to_numpy(dtype=float)
            n += y.size
            for i, net in nets.items():
                err = (net.predict(x) - y) / np.array(net.y_scaler)[:, 1]
                total[i] += float((err * err).sum())
        if n:
            yield pd.DataFrame({"net_id": list(total), "n": n, "sse": list(total.values())})

    parts = df.select(*inputs, *outputs).mapInPandas(partial, "net_id long, n long, sse double")
    return parts.groupBy("net_id").agg((F.sum("sse") / F.sum("n")).alias(score))


# decay-step rule and optimiser constants (fixed values)
DECAY_SHARE = 1e-3
ADAM = (0.9, 0.999, 1e-8)


def mlp_fit(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], hidden: Sequence[int], epochs: int,
            alpha_expo: float = -2.0, lr_decay: float = 0.99, batch_expo: int = 6, activation: str = "tanh",
            x_scaler: Sequence[tuple[float, float]] = (), y_scaler: Sequence[tuple[float, float]] = (),
            seed: int = 1, patience: int = 200, tol: float = 1e-11) -> tuple[Network, list[float]]:
    """Fit a network by data-parallel full-batch gradient descent with Adam.

    Each epoch is one Spark job: a task adds up the gradient of its rows, the partial gradients are
    summed by parameter on the cluster, and the driver holds the parameters only. Persist or write
    the input before calling. The learning rate is 10^alpha * decay^(step/steps), where an epoch counts as
    the n / 2^batch_expo steps that mini-batches of that size would make.
    """
    rng = np.random.default_rng(seed)
    sizes = [len(inputs), *hidden, len(outputs)]
    limit = [math.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    net = Network(list(inputs), list(outputs),
                  [rng.uniform(-u, u, (a, b)) for u, a, b in zip(limit, sizes, sizes[1:])],
                  [np.zeros(b) for b in sizes[1:]], activation, list(x_scaler), list(y_scaler))
    data = df.select(*inputs, *outputs).dropna()
    n = data.count()
    steps = max(1.0, math.floor(DECAY_SHARE * epochs * n / 2 ** batch_expo))
    m = v = None
    losses: list[float] = []
    best, stale = math.inf, 0
    for epoch in range(epochs):
        grad, loss = _gradient(data, net)
        losses.append(loss)
        if math.isnan(loss):
            break
        best, stale = (loss, 0) if loss < best - tol else (best, stale + 1)
        if stale > patience:
            break
        b1, b2, eps = ADAM
        m = grad * (1 - b1) if m is None else b1 * m + (1 - b1) * grad
        v = grad ** 2 * (1 - b2) if v is None else b2 * v + (1 - b2) * grad ** 2
        rate = 10 ** alpha_expo * lr_decay ** (epoch * n / 2 ** batch_expo / steps)
        step = rate * (m / (1 - b1 ** (epoch + 1))) / (np.sqrt(v / (1 - b2 ** (epoch + 1))) + eps)
        at = 0
        for p in [*net.weights, *net.biases]:
            p -= step[at:at + p.size].reshape(p.shape)
            at += p.size
    return net, losses


def _gradient(data: DataFrame, net: Network) -> tuple[np.ndarray, float]:
    phi, slope = ACTIVATIONS[net.activation]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sse, n = None, 0.0, 0
        xo, xs = np.array(net.x_scaler).T
        yo, ys = np.array(net.y_scaler).T
        for pdf in batches:
            a = [(pdf[net.inputs].to_numpy(dtype=float) - xo) / xs]
            t = (pdf[net.outputs].to_numpy(dtype=float) - yo) / ys
            z = []
            for w, b in zip(net.weights, net.biases):
                z.append(a[-1] @ w + b)
                a.append(phi(z[-1]) if len(z) < len(net.weights) else z[-1])
            err = a[-1] - t
            sse, n = sse + float((err * err).sum()), n + err.size
            back, gw, gb = 2.0 * err, [], []
            for i in range(len(net.weights) - 1, -1, -1):
                gw.insert(0, a[i].T @ back)
                gb.insert(0, back.sum(axis=0))
                if i:
                    back = (back @ net.weights[i].T) * slope(z[i - 1])
            flat = np.concatenate([g.ravel() for g in [*gw, *gb]])
            total = flat if total is None else total + flat
        if n:
            yield pd.DataFrame({"g": [np.append(total, [sse, n])]})

    parts = data.mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("i", "v"))
    summed = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # one row per parameter
    flat = np.array([r["v"] for r in summed])
    return flat[:-2] / flat[-1], float(flat[-2] / flat[-1])


def cost_parameter(weights: DataFrame) -> DataFrame:
    """Number of weights per network of a long table ``(net_id, layer, i, j, w)``."""
    return weights.groupBy("net_id").agg(F.count(F.lit(1)).alias("cost"))


def error_table(df: DataFrame, pairs: dict[str, tuple[str, str]], probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per output: mean squared error, R2 and exact quantiles of the percent error."""
    cols = {n: (F.col(p), F.col(r)) for n, (p, r) in pairs.items()}
    err = df.select(*[percent_error(p, r, signed_reference=False).alias(n) for n, (p, r) in cols.items()])
    quant = exact_quantiles(err, list(pairs), probs)
    e, q = mse(df, cols), r2(df, cols)
    # one row of statistics
    row_e, row_q = e.first(), q.first()
    rows = [(n, row_e[f"mse_{n}"], row_q[f"r2_{n}"], *quant[n]) for n in pairs]
    schema = "output string, mse double, r2 double, " + ", ".join(f"pct_{round(100 * p)} double" for p in probs)
    return df.sparkSession.createDataFrame(rows, schema)


def error_table_by_region(df: DataFrame, pairs: dict[str, tuple[str, str]], regions: dict[str, Column],
                          probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The error table of each named region, a condition on the rows; regions may overlap."""
    parts = [error_table(df.where(rows), pairs, probs).select(F.lit(name).alias("region"), "*") for name, rows in regions.items()]
    return reduce(DataFrame.unionByName, parts)


def score_state(df: DataFrame, net: Network) -> DataFrame:
    """Network for the entropy derivatives, inverse target transform, then the state equations."""
    scored = mlp_score(df, net, prefix="")
    return entropic_state(scored.withColumns(inverse_log_targets()))


def history_curves(runs: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """Per run: epochs, best epoch and loss, last loss, first epoch of a NaN loss."""
    bad = F.isnan(loss) | F.col(loss).isNull()
    good = F.when(~bad, F.col(loss))
    return runs.groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.min_by(epoch, F.when(~bad, F.struct(loss, epoch))).alias("best_epoch"), F.min(good).alias("best_loss"),
        F.max_by(loss, epoch).alias("last_loss"), F.min(F.when(bad, F.col(epoch))).alias("first_nan"))


STAGNATION_TOLERANCE = 1e-11
STAGNATION_PATIENCE = 200


def early_stop(history: DataFrame, run: str, epoch: str, loss: str, patience: int = STAGNATION_PATIENCE,
               tol: float = STAGNATION_TOLERANCE, block_rows: int = 1_000_000) -> DataFrame:
    """Best epoch and stopping epoch per run.

    The running best moves only on an improvement above ``tol``; training stops after more than
    ``patience`` epochs without one, or on NaN. Each step depends on the step before, so a run is
    walked in blocks of ``block_rows`` epochs with its state carried between rounds; all runs advance
    together and stopped runs leave.
    """
    run_type, epoch_type = (history.schema[c].dataType.simpleString() for c in (run, epoch))
    rows, key = index_rows(history.select(run, epoch, loss), run, [epoch], chunk_rows=block_rows)
    rows = rows.withColumn("_block", F.floor(F.col(key.order) / F.lit(block_rows)).cast("long"))
    fields = f"`{run}` {run_type}, best_epoch {epoch_type}, best_loss double, stale long, stop_epoch {epoch_type}"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(epoch, kind="stable")
        first = pdf.iloc[0]
        best = math.inf if pd.isna(first["best_loss"]) else float(first["best_loss"])
        best_epoch = None if pd.isna(first["best_epoch"]) else first["best_epoch"]
        stale, stop = int(0 if pd.isna(first["stale"]) else first["stale"]), None
        for e, x in zip(pdf[epoch], pdf[loss].to_numpy(dtype=float)):
            if math.isnan(x):
                stop = e
                break
            if x < best - tol:
                best, best_epoch, stale = x, e, 0
            else:
                stale += 1
                if stale > patience:
                    stop = e
                    break
        return pd.DataFrame({run: [first[run]], "best_epoch": pd.array([best_epoch], dtype="Int64"), "best_loss": [best],
                             "stale": [stale], "stop_epoch": pd.array([stop], dtype="Int64")})

    blocks = rows.agg(F.max("_block")).first()[0]
    if blocks is None:
        return history.sparkSession.createDataFrame([], fields).drop("stale")
    state, done = None, None
    for b in range(blocks + 1):
        part = rows.where(F.col("_block") == b).drop("_block", key.order)
        if state is None:
            part = part.withColumns({"best_epoch": F.lit(None).cast(epoch_type), "best_loss": F.lit(None).cast("double"),
                                     "stale": F.lit(None).cast("long")})
        else:
            part = part.join(state.drop("stop_epoch"), run)
        got = part.groupBy(run).applyInPandas(walk, fields)
        if b == blocks:
            ended = got if state is None else got.unionByName(state.join(got.select(run), run, "left_anti"))
        else:
            got = cut_lineage(got if state is None else got.unionByName(state.join(got.select(run), run, "left_anti")))
            ended = got.where("stop_epoch is not null")
            state = got.where("stop_epoch is null")
        done = ended if done is None else done.unionByName(ended)
        if b < blocks and state.limit(1).count() == 0:
            break
    return done.drop("stale")
