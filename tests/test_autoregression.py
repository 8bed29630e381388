"""Coefficients against the normal equations, the chosen order against all orders."""

import numpy as np
from pyspark.sql import functions as F

from fxspark.operators import volume as vo


def plain(x, most):
    """Order, coefficients and forecast by solving the normal equations of each order."""
    x = np.asarray(x, float)
    n, mean = len(x), x.mean()
    d = x - mean
    r = [float(d[k:] @ d[: n - k]) / n for k in range(most + 1)]
    if d.any() and r[0] > 0:
        best = None
        for m in range(most + 1):
            a = np.linalg.solve([[r[abs(i - j)] for j in range(m)] for i in range(m)], r[1 : m + 1]) if m else np.zeros(0)
            error = r[0] - float(a @ r[1 : m + 1])
            aic = n * np.log(error) + 2 * (m + 1)
            if best is None or aic < best[0]:
                best = aic, m, a
        return best[1], best[2], mean + float(best[2] @ d[::-1][: best[1]])
    return 0, np.zeros(0), mean


def test_orders_and_coefficients(spark):
    r = np.random.default_rng(6)
    made = {}
    for pair, n in (("A", 400), (None, 90), ("B", 5), ("C", 30), ("flat", 12), ("short", 4)):
        x = r.normal(size=n)
        for t in range(3, n):
            x[t] += {"A": 0.6 * x[t - 1] - 0.5 * x[t - 2] + 0.3 * x[t - 3], "C": 0.8 * x[t - 1]}.get(pair, 0.0)
        made[pair] = [7.0] * n if pair == "flat" else [float(v) for v in 100 + 10 * x]
    rows = [(p, 3, i, v) for p, xs in made.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "pair string, hour_gmt int, day int, hourly_volume double").withColumn("date", F.date_add(F.lit("2022-01-01").cast("date"), F.col("day"))).drop("day")
    got = {x.pair: x for x in vo.autoregression(df.repartition(4), 4).collect()}
    assert set(got) == set(made) - {"short"} and got["A"].ar_order >= 3
    for pair, x in got.items():
        order, a, ahead = plain(made[pair], 4)
        assert (x.ar_order, x.n_points) == (order, len(made[pair]))
        np.testing.assert_allclose(x.coefficients, a, rtol=1e-9, atol=1e-12)
        assert np.isclose(x.next_volume_forecast, ahead, rtol=1e-10)
    assert vo.autoregression(df.limit(0)).count() == 0
