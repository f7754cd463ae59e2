"""Variance inflation and factor correlation over spans of positions against numpy."""

import numpy as np
import pytest

from barloom.operators import redundancy as rd


def series(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 6000))
    made = {f"f{i}": base[i][: 6000 - 300 * i] for i in range(3)}
    for i, n in enumerate((5000, 5000, 4200, 700, 9)):
        made[f"c{i}"] = 0.4 * base[0][:n] - 0.2 * base[2][:n] + rng.normal(size=n) * (1 + i)
    pdf = [(k, j + 1, float(x)) for k, xs in made.items() for j, x in enumerate(xs)]
    import pandas as pd

    return made, spark.createDataFrame(pd.DataFrame(pdf, columns=["alpha_id", "from_end", "ret"]))


@pytest.mark.parametrize("met", [256, 1])
def test_vif_over_spans_and_parts(spark, monkeypatch, met):
    monkeypatch.setattr(rd, "MET", met)
    made, df = series(spark)
    got = {r.alpha_id: r.vif for r in rd.vif(df, ["f0", "f1", "f2"]).collect()}
    for k, xs in made.items():
        if k.startswith("f"):
            assert k not in got
            continue
        n = min(len(xs), 5400)
        if n < 10:
            assert got[k] == 1.0
            continue
        f = np.stack([made[f"f{i}"][:n] - made[f"f{i}"][:n].mean() for i in range(3)], axis=1)
        y = xs[:n] - xs[:n].mean()
        left = y - f @ np.linalg.lstsq(f, y, rcond=None)[0]
        assert got[k] == pytest.approx((y @ y) / (left @ left), rel=1e-9)


def test_correlation_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(rd, "DEALT", 1000)
    made, df = series(spark)
    got = {r.alpha_id: r.max_corr for r in rd.factor_correlation(df, ["f0", "f1", "f2"], 0.5, at="from_end").collect()}
    for k in ("c0", "c2", "c3"):
        want = max(abs(np.corrcoef(made[k][: min(len(made[k]), len(made[f]))], made[f][: len(made[k])])[0, 1]) for f in ("f0", "f1", "f2"))
        assert got[k] == pytest.approx(want, rel=1e-9)
