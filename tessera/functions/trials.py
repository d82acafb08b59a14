"""Expressions over trial rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# scores given to trials that ended in NaN, and the numerator of the cost fitness (fixed values)
NAN_SCORE_TRAINING = 100.0
NAN_SCORE_REPORT = 10.0
COST_NUMERATOR = 1000.0


def valid_score(score: Column, fallback: float = NAN_SCORE_REPORT) -> Column:
    return F.when(score.isNull() | F.isnan(score), F.lit(fallback)).otherwise(score)


def score_fitness(score: Column) -> Column:
    return -F.log10(score)


def score_from_fitness(fitness: Column) -> Column:
    return F.pow(F.lit(10.0), -fitness)


def cost_fitness(cost: Column) -> Column:
    return F.try_divide(F.lit(COST_NUMERATOR), cost)


cost_from_fitness = cost_fitness  # its own inverse


def decode_genes(genes: Column, activations: Sequence[str], layers_min: int, learning_rate: bool = True,
                 batch: bool = True, activation: bool = True, architecture: bool = True) -> dict[str, Column]:
    """Hyper-parameters from a flat gene vector (an array column).

    Order: learning-rate exponent and decay, batch exponent, activation index, then ``layers_min``
    layer widths followed by (active flag, width) pairs.
    """
    out: dict[str, Column] = {}
    at = 1  # element positions are 1-based
    if learning_rate:
        out["alpha_expo"] = F.element_at(genes, at)
        out["lr_decay"] = F.element_at(genes, at + 1)
        at += 2
    if batch:
        out["batch_expo"] = F.element_at(genes, at).cast("int")
        at += 1
    if activation:
        names = F.array(*[F.lit(a) for a in activations])
        out["activation"] = F.element_at(names, F.element_at(genes, at).cast("int") + 1)
        at += 1
    if architecture:
        fixed = F.slice(genes, at, layers_min)
        rest = F.slice(genes, F.lit(at + layers_min), F.size(genes) - F.lit(at + layers_min - 1))
        pairs = F.filter(F.transform(rest, lambda g, i: F.when(
            (i % 2 == 1) & (F.get(rest, i - 1) > 0), g)), lambda g: g.isNotNull())
        out["hidden_layers"] = F.transform(F.concat(fixed, pairs), lambda w: w.cast("int"))
    return out
