"""Histogram, density and box statistics against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from shoplens.operators.distributions import box_statistics, density_curve, histogram


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"customer_id": np.arange(len(values)), "x": values.astype(float)}))


@pytest.mark.parametrize("bins", [15, 20])
@pytest.mark.parametrize("seed", range(3))
def test_histogram(spark, bins, seed):
    rng = np.random.default_rng(seed)
    values = [rng.integers(18, 81, 500), np.round(rng.normal(65000, 20000, 500), 2), rng.random(500) * 0.3][seed]
    rows = histogram(frame(spark, values), "x", bins).collect()
    counts, edges = np.histogram(values, bins)
    assert [r["customers"] for r in rows] == counts.tolist()
    assert [r["bin_start"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1]["bin_end"] == edges[-1]


def test_histogram_of_one_value_and_of_nothing(spark):
    one = histogram(frame(spark, np.array([7.0, 7.0])), "x", 4).collect()
    assert [r["customers"] for r in one] == np.histogram([7.0, 7.0], 4)[0].tolist()
    assert (one[0]["bin_start"], one[-1]["bin_end"]) == (6.5, 7.5)
    none = histogram(frame(spark, np.array([1.0])).where("false"), "x", 4).collect()
    assert [r["customers"] for r in none] == [0, 0, 0, 0]


def test_density(spark):
    values = np.random.default_rng(5).integers(18, 81, 400).astype(float)
    rows = density_curve(frame(spark, values), "x", 20).collect()
    width = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    expected = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert [r["x"] for r in rows] == pytest.approx(grid.tolist(), abs=1e-6)
    assert [r["density"] for r in rows] == pytest.approx(expected.tolist(), abs=1e-6)
    unit = len(values) * (values.max() - values.min()) / 20
    assert [r["scaled"] for r in rows] == pytest.approx((expected * unit).tolist(), abs=1e-5)
    assert density_curve(frame(spark, np.array([3.0, 3.0])), "x", 20).count() == 0


def test_box(spark, store):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"customer_id": np.arange(900), "g": rng.integers(1, 4, 900), "x": rng.lognormal(3, 1, 900)})
    rows = box_statistics(spark.createDataFrame(pdf), "g", "x", store).collect()
    assert [r["g"] for r in rows] == [1, 2, 3]
    for r in rows:
        x = pdf[pdf["g"] == r["g"]]["x"].to_numpy()
        q1, mid, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, mid, q3))
        assert (r["customers"], r["lowest"], r["highest"]) == (len(x), x.min(), x.max())
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert r["outliers"] == len(x) - len(inside)
