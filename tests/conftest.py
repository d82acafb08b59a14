from __future__ import annotations

import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SPECIES = ("H2", "O2", "N2", "H2O", "NO")


def header() -> list[str]:
    cols = ["Distance", "Velocity"]
    for family in ("Y-", "Y_dot_net-", "Y_dot_pos-", "Y_dot_neg-", "Cp-", "h-", "Le-"):
        cols += [family + s for s in SPECIES]
    return cols + ["EnthalpyTot", "MixtureFraction", "Temperature", "Density", "MolarWeightMix", "Cp", "Conductivity",
                   "ViscosityDyn", "Heat_Release"]


def profile(phi: float, t_u: float, n: int, burning: bool = True, width: float = 0.1, flat: bool = False) -> np.ndarray:
    x = np.linspace(0.0, width, n)
    c = np.zeros(n) if flat else 1.0 / (1.0 + np.exp(-(x / width - 0.5) * 14.0))
    y = {"H2": 0.03 * phi * (1 - c), "O2": 0.22 * (1 - 0.9 * c), "N2": np.full(n, 0.74), "H2O": 0.2 * phi * c, "NO": 1e-3 * c * c}
    rate = c * (1 - c) * 100.0
    out = {"Distance": x, "Velocity": 1.0 + c}
    for k, s in enumerate(SPECIES):
        out["Y-" + s] = y[s]
        out["Y_dot_net-" + s] = rate * (k - 2.0)
        out["Y_dot_pos-" + s] = rate * (k + 1.0)
        out["Y_dot_neg-" + s] = -rate * 0.5
        out["Cp-" + s] = 1000.0 + 100.0 * k + 0.1 * c
        out["h-" + s] = 1e5 * (k - 2.0) + 10.0 * c
        out["Le-" + s] = 0.3 + 0.3 * k + 0.01 * c
    t = t_u + (2000.0 if burning else 100.0) * c
    out |= {"EnthalpyTot": np.full(n, 1000.0 * t_u * phi) + (0 if flat else 5.0 * x), "MixtureFraction": np.full(n, 0.03 * phi) + 1e-4 * c,
            "Temperature": t, "Density": 300.0 / t, "MolarWeightMix": 25.0 - c, "Cp": 1200.0 + 100.0 * c,
            "Conductivity": 0.02 + 0.1 * c, "ViscosityDyn": 1e-5 * (1 + c), "Heat_Release": rate * 1e6}
    return np.column_stack([out[h] for h in header()])


@pytest.fixture(scope="session")
def profile_tree(tmp_path_factory):
    """Three kinds, mixtures whose string order differs from their numeric order, and odd cases."""
    root = tmp_path_factory.mktemp("profiles")

    def write(path: str, data: np.ndarray) -> None:
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        np.savetxt(full, data, delimiter=",", header=",".join(header()), comments="", fmt="%.17g")

    for phi in (0.5, 1.0, 2.0, 10.0):
        for i, t_u in enumerate((300.0, 350.0)):
            write(f"freeflame_data/phi_{phi}/freeflamelet_phi{phi}_Tu{t_u}.csv", profile(phi, t_u, 40 + 7 * i))
        write(f"burnerflame_data/phi_{phi}/burnerflamelet_phi{phi:.6f}_mdot0.1.csv", profile(phi, 320.0, 50))
        write(f"equilibrium_data/phi_{phi}/equilibrium_b_phi_{phi}.csv", profile(phi, 900.0, 20))
    write("freeflame_data/phi_1.0/freeflamelet_phi1.0_Tu400.0.csv", profile(1.0, 400.0, 30, burning=False))
    write("freeflame_data/phi_1.0/freeflamelet_phi1.0_Tu450.0.csv", profile(1.0, 450.0, 30, flat=True))
    write("freeflame_data/phi_1.0/freeflamelet_phi1.0_Tu500.0.csv", profile(1.0, 500.0, 30, width=0.3))
    (root / "freeflame_data" / "phi_3.0").mkdir(parents=True)
    return str(root)
