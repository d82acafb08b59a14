"""Grouping of output columns by correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import cut_lineage

AFFINITY_THRESHOLD = 0.7  # smallest accepted affinity (fixed value)
TRIALS = 10_000  # number of accepted trials (fixed value)
MAX_ROUND = 200_000  # trials drawn in one job
HOPELESS = 1_000_000  # rejected trials after which the search gives up


def group_columns(spark: SparkSession, corr: dict[tuple[str, str], float], names: Sequence[str],
                  leaders: Sequence[str] = (), n_trials: int = TRIALS, theta: float = AFFINITY_THRESHOLD,
                  seed: int = 1) -> DataFrame:
    """Accepted random groupings ``(trial, n_groups, affinity, groups)``.

    A trial draws extra leaders and lets the other columns, in random order, join the group with the
    largest product of |r| to its members; it is accepted when every affinity reaches ``theta``. Trials
    are drawn in numbered rounds until ``n_trials`` are accepted, of which the lowest numbers are kept.
    Each trial draws from its own seed, so the table does not depend on the partitioning. ``ValueError``
    if a million trials in a row are all rejected: no grouping then is likely to reach ``theta``.
    """
    names = list(names)
    r = np.array([[abs(corr.get((a, b)) or 0.0) for b in names] for a in names])
    fixed = [names.index(g) for g in leaders]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for trial in pdf["id"]:
                rng = np.random.default_rng([seed, int(trial)])
                free = [i for i in range(len(names)) if i not in fixed]
                extra = rng.permutation(free)[:rng.integers(1, max(len(free), 2))]
                members = [[int(i)] for i in [*fixed, *extra]]
                affinity = np.ones(len(members))
                for v in rng.permutation([i for i in free if i not in set(extra.tolist())]):
                    v = int(v)
                    gain = np.array([np.prod(r[v, v] * r[v, m]) for m in members])
                    best = int(np.argmax(gain))
                    members[best].append(v)
                    affinity[best] = min(affinity[best], gain[best])
                if affinity.min() >= theta:
                    groups = sorted(sorted(names[i] for i in m) for m in members)
                    out.append((int(trial), len(groups), float(affinity.min()), groups))
            yield pd.DataFrame(out, columns=["trial", "n_groups", "affinity", "groups"])

    schema = "trial long, n_groups int, affinity double, groups array<array<string>>"
    rounds, drawn, size, missing = [], 0, n_trials, n_trials
    while missing > 0:
        got = cut_lineage(spark.range(drawn, drawn + size).mapInPandas(run, schema))
        accepted = got.count()
        if accepted == 0 and drawn + size >= HOPELESS and missing == n_trials:
            raise ValueError(f"none of {drawn + size} trials reaches an affinity of {theta}")
        rounds.append(got)
        drawn, missing = drawn + size, missing - accepted
        size = int(min(MAX_ROUND, max(n_trials, 1.2 * missing * size / max(accepted, 1))))
    return reduce(DataFrame.unionByName, rounds).orderBy("trial").limit(n_trials)


def best_groups(trials: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """The best trial per group count, its number of network evaluations, and whether it is chosen.

    A group costs one evaluation for each family it has a member of; the cheapest count wins, the
    smaller one on ties.
    """
    w = Window.partitionBy("n_groups").orderBy(F.desc("affinity"), "trial")
    best = trials.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    cost = F.lit(0)
    for members in families.values():
        wanted = F.array(*[F.lit(m) for m in members])
        cost = cost + F.size(F.filter("groups", lambda g: F.arrays_overlap(g, wanted)))
    best = best.withColumn("evaluations", cost)
    # one row per group count
    first = best.agg(F.min(F.struct("evaluations", "n_groups")).alias("m"))
    return best.withColumn("chosen", F.struct("evaluations", "n_groups") == first.scalar())
