"""Network scoring, fitting and history queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.views import rounded, table
from tessera.operators import surrogate as SU
from tessera.operators.stats import fit_scaler
from tessera.runtime import checkpoint_dir, cut_lineage
from tessera.streaming.scoring import score_stream

_IN, _OUT = ["l_quantity", "l_discount"], ["l_extendedprice"]


def _network(activation: str, seed: int = 1, outputs: list[str] = _OUT) -> SU.Network:
    rng = np.random.default_rng(seed)
    sizes = [2, 4, 3, len(outputs)]
    return SU.Network(_IN, outputs, [np.round(rng.uniform(-1, 1, (a, b)), 3) for a, b in zip(sizes, sizes[1:])],
                      [np.round(rng.uniform(-0.5, 0.5, b), 3) for b in sizes[1:]], activation,
                      [(1.0, 49.0), (0.0, 0.1)], [(1000.0, 100000.0)] * len(outputs))


_PHI = {"linear": "{z}", "elu": "CASE WHEN {z} > 0 THEN {z} ELSE exp({z}) - 1 END", "relu": "greatest({z}, 0e0)", "tanh": "tanh({z})",
        "exponential": "exp({z})", "sigmoid": "1 / (1 + exp(-({z})))", "swish": "{z} / (1 + exp(-({z})))"}


def _num(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _score_sql(net: SU.Network, keep: str, source: str = "lineitem", digits: int = 4) -> str:
    """Layer by layer as nested subqueries."""
    prev = ", ".join(f"({c} - {_num(o)}) / {_num(s)} AS h0_{i}" for i, (c, (o, s)) in enumerate(zip(net.inputs, net.x_scaler)))
    sql = f"SELECT *, {prev} FROM {source}"
    for layer, (w, b) in enumerate(zip(net.weights, net.biases)):
        cols = []
        for j in range(w.shape[1]):
            z = "(" + " + ".join(f"h{layer}_{i} * {_num(w[i, j])}" for i in range(w.shape[0])) + f" + ({float(b[j])!r}e0))"
            cols.append((z if layer == len(net.weights) - 1 else _PHI[net.activation].format(z=z)) + f" AS h{layer + 1}_{j}")
        sql = f"SELECT *, {', '.join(cols)} FROM ({sql})"
    n = len(net.weights)
    outs = ", ".join(f"round(h{n}_{j} * {_num(s)} + {_num(o)}, {digits}) AS pred_{c}" for j, (c, (o, s)) in enumerate(zip(net.outputs, net.y_scaler)))
    return f"SELECT {keep}, {outs} FROM ({sql})"


_KEEP = "l_orderkey, l_linenumber, l_quantity, l_discount"


def _rows(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_IN)


for _a in ("linear", "elu", "relu", "tanh", "exponential", "sigmoid", "swish"):
    @query(f"mlp_score_{_a}", _score_sql(_network(_a), _KEEP))
    def _score(spark, d, a=_a):
        return SU.mlp_score(_rows(spark, d), _network(a)).withColumn("pred_l_extendedprice", F.round("pred_l_extendedprice", 4))


@query("mlp_score_gelu")
def _gelu(spark, d):
    return SU.mlp_score(_rows(spark, d), _network("gelu"))


@query("mlp_score_columns", _score_sql(_network("swish"), _KEEP))
def _columns(spark, d):
    return SU.mlp_score_columns(_rows(spark, d), _network("swish")).withColumn("pred_l_extendedprice", F.round("pred_l_extendedprice", 4))


@query("mlp_score_many", "SELECT net_id, round(mse, 6) AS mse FROM (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS net_id, avg(((pred_l_extendedprice - l_extendedprice) / 100000e0) * ((pred_l_extendedprice - l_extendedprice) / 100000e0)) AS mse FROM ({_score_sql(_network('tanh', i), 'l_extendedprice', digits=9)})"
    for i in range(4)) + ")")
def _many(spark, d):
    df = table(spark, d, "lineitem").select(*_IN, *_OUT)
    return rounded(SU.mlp_score_many(df, {i: _network("tanh", i) for i in range(4)}))


@query("mlp_fit")
def _fit(spark, d):
    """A short fit of the price; one row per epoch, the loss falls."""
    df = cut_lineage(table(spark, d, "lineitem").select(*_IN, *_OUT))
    x, y = fit_scaler(df, _IN), fit_scaler(df, _OUT)
    _, losses = SU.mlp_fit(df, _IN, _OUT, [6], epochs=6, alpha_expo=-1.0, x_scaler=list(x.values()), y_scaler=list(y.values()))
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query("cost_parameter", "SELECT CAST(p_size AS BIGINT) AS net_id, count(*) AS cost FROM part GROUP BY p_size")
def _cost(spark, d):
    """Parts as the rows of a long weight table, one network per size."""
    return SU.cost_parameter(table(spark, d, "part").select(F.col("p_size").cast("long").alias("net_id")))


@query("error_table", """WITH e AS (SELECT l_quantity * 2100e0 AS p, l_extendedprice AS r FROM lineitem), m AS (SELECT avg(r) AS m FROM e)
SELECT 'price' AS output, round(avg((p - r) * (p - r)), 1) AS mse, round(1 - sum((r - p) * (r - p)) / sum((r - m) * (r - m)), 6) AS r2,
  round(quantile_cont(100 * abs(p - r) / (abs(r) + 1e-6), 0.5), 5) AS pct_50, round(quantile_cont(100 * abs(p - r) / (abs(r) + 1e-6), 0.9), 5) AS pct_90 FROM e, m""")
def _errors(spark, d):
    df = table(spark, d, "lineitem").select(F.expr("l_quantity * 2100e0").alias("p"), F.col("l_extendedprice").alias("r"))
    got = SU.error_table(df, {"price": ("p", "r")}, (0.5, 0.9))
    return got.select("output", F.round("mse", 1).alias("mse"), F.round("r2", 6).alias("r2"), F.round("pct_50", 5).alias("pct_50"), F.round("pct_90", 5).alias("pct_90"))


_REGIONS = {"small": "l_quantity < 10", "large": "l_quantity >= 30"}


@query("error_table_by_region", " UNION ALL ".join(f"""(WITH e AS (SELECT l_quantity * 2100e0 AS p, l_extendedprice AS r FROM lineitem WHERE {rows}), m AS (SELECT avg(r) AS m FROM e)
SELECT '{name}' AS region, 'price' AS output, round(avg((p - r) * (p - r)), 1) AS mse, round(1 - sum((r - p) * (r - p)) / sum((r - m) * (r - m)), 6) AS r2,
  round(quantile_cont(100 * abs(p - r) / (abs(r) + 1e-6), 0.5), 5) AS pct_50 FROM e, m)""" for name, rows in _REGIONS.items()))
def _region_errors(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", F.expr("l_quantity * 2100e0").alias("p"), F.col("l_extendedprice").alias("r"))
    got = SU.error_table_by_region(df, {"price": ("p", "r")}, {n: F.expr(c) for n, c in _REGIONS.items()}, (0.5,))
    return got.select("region", "output", F.round("mse", 1).alias("mse"), F.round("r2", 6).alias("r2"), F.round("pct_50", 5).alias("pct_50"))


_STATE_OUT = ["s", "dsdrho_e", "dsde_rho", "d2sdrho2", "d2sdedrho", "d2sde2"]


def _state_net() -> SU.Network:
    net = _network("tanh", 5, _STATE_OUT)
    net.y_scaler = [(1000.0, 100.0), (1.0, 0.5), (0.01, 0.001), (2.0, 0.5), (-1e-5, 1e-6), (-1e-5, 1e-6)]
    return net


@query("score_state", f"""WITH s AS ({_score_sql(_state_net(), 'l_orderkey, l_linenumber, l_quantity', digits=15)}),
a AS (SELECT *, l_quantity AS r, -exp(pred_dsdrho_e) AS sr, pred_dsde_rho AS se, exp(pred_d2sdrho2) AS srr, pred_d2sdedrho AS sre, pred_d2sde2 AS see FROM s)
SELECT l_orderkey, l_linenumber, round(1 / se, 4) AS "T", round(-r * r * sr / se, 2) AS p, round(log10(abs(-(r / se) * (2 * sr + r * (srr - 2 * sr * sre / se + sr * sr * see / (se * se))))), 6) AS log_c2 FROM a""")
def _state(spark, d):
    df = _rows(spark, d).withColumn("Density", F.col("l_quantity"))
    got = SU.score_state(df, _state_net())
    return got.select("l_orderkey", "l_linenumber", F.round("T", 4).alias("T"), F.round("p", 2).alias("p"),
                      F.round(F.log10(F.abs("c2")), 6).alias("log_c2"))


_RUNS = "runs AS (SELECT user_id AS run, event_id AS epoch, CASE WHEN value > 400 THEN 'nan'::DOUBLE ELSE value END AS loss FROM events)"


def _runs(spark, d):
    loss = F.when(F.col("value") > 400, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), loss.alias("loss"))


@query("history_curves", f"""WITH {_RUNS}, g AS (SELECT * FROM runs WHERE NOT isnan(loss)),
b AS (SELECT run, epoch AS best_epoch, loss AS best_loss FROM g QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1)
SELECT run, count(*) AS epochs, any_value(best_epoch) AS best_epoch, any_value(best_loss) AS best_loss, arg_max(loss, epoch) AS last_loss,
  min(CASE WHEN isnan(loss) THEN epoch END) AS first_nan FROM runs LEFT JOIN b USING (run) GROUP BY run""")
def _history(spark, d):
    return SU.history_curves(_runs(spark, d), "run", "epoch", "loss")


@query("early_stop", f"""WITH RECURSIVE {_RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM runs),
f AS (SELECT run, i, epoch, CASE WHEN isnan(loss) THEN 'inf'::DOUBLE ELSE loss END AS best, CASE WHEN isnan(loss) THEN NULL ELSE epoch END AS best_epoch, 0 AS stale, isnan(loss) AS stop FROM n WHERE i = 1
  UNION ALL SELECT n.run, n.i, n.epoch, CASE WHEN NOT isnan(n.loss) AND n.loss < f.best - 1e-11 THEN n.loss ELSE f.best END,
    CASE WHEN NOT isnan(n.loss) AND n.loss < f.best - 1e-11 THEN n.epoch ELSE f.best_epoch END,
    CASE WHEN n.loss < f.best - 1e-11 THEN 0 ELSE f.stale + 1 END, isnan(n.loss) OR (NOT n.loss < f.best - 1e-11 AND f.stale + 1 > 20)
  FROM f JOIN n ON n.run = f.run AND n.i = f.i + 1 WHERE NOT f.stop)
SELECT run, arg_max(best_epoch, i) AS best_epoch, min(best) AS best_loss, min(CASE WHEN stop THEN epoch END) AS stop_epoch FROM f GROUP BY run""")
def _early(spark, d):
    return SU.early_stop(_runs(spark, d), "run", "epoch", "loss", patience=20)


@query("score_stream", _score_sql(_network("tanh"), _KEEP))
def _stream(spark, d):
    """Network scoring of the line items as a stream of files, read back from its sink."""
    root = f"{checkpoint_dir(spark)}/score-{uuid.uuid4().hex}"
    schema = _rows(spark, d).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    run = score_stream(source, _network("tanh"), f"{root}/out", f"{root}/state")
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return spark.read.parquet(f"{root}/out").withColumn("pred_l_extendedprice", F.round("pred_l_extendedprice", 4))
