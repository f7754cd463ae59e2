import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import stats as st


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("z", [-38.0, -8.0, -3.3, -0.5, 0.0, 0.7, 2.0, 6.9, 7.5])
def test_normal(spark, z):
    assert one(spark, st.norm_cdf(F.lit(z))) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize(
    "t,nu,two_sided", [(2.228, 10, 0.05), (12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (1.984, 100, 0.05), (1.962, 1000, 0.05)]
)
def test_student_table(spark, t, nu, two_sided):
    p = one(spark, st.t_p_one_sided(F.lit(t), F.lit(nu)))
    assert 2 * p == pytest.approx(two_sided, abs=2e-4)
    assert one(spark, st.t_p_one_sided(F.lit(-t), F.lit(nu))) == pytest.approx(1 - p, abs=1e-12)


def test_incomplete_beta_against_plain_sums():
    """P(X >= k) of a binomial is an incomplete beta; large parameters keep the symmetry and the normal limit."""
    import numpy as np

    for n, k, x in [(5, 2, 0.3), (40, 11, 0.5), (200, 150, 0.7), (1500, 700, 0.47)]:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log(1 - x)) for j in range(k, n + 1))
        assert st.incomplete_beta(np.array(float(k)), np.array(n - k + 1.0), np.array(x)).item() == pytest.approx(want, rel=1e-9)
    a = np.array([0.5, 3.0, 1e5, 1e8])
    assert np.allclose(st.incomplete_beta(a, a, np.array(0.5)), 0.5, rtol=1e-6)
    assert list(st.incomplete_beta(a, a, np.array(0.0))) == [0] * 4 and list(st.incomplete_beta(a, a, np.array(1.0))) == [1] * 4


@pytest.mark.parametrize("wins,n,want", [(560, 1002, 0.000215530), (501, 1002, 1.0), (500_600, 1_000_000, 0.230528)])
def test_binomial_of_many_trials(spark, wins, n, want):
    assert one(spark, st.binomial_p_two_sided(F.lit(wins), F.lit(n))) == pytest.approx(want, rel=2e-5)


def test_no_spread(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 4), (-1.0, 0.0, 4), (0.0, 0.0, 4), (1.0, None, 1)], "m double, s double, n long")
    got = [r["p"] for r in rows.select(st.t_test_p(F.col("m"), F.col("s"), F.col("n")).alias("p")).collect()]
    assert got == [0.0, 1.0, None, None]


@pytest.mark.parametrize("wins,n", [(0, 4), (3, 4), (2, 4), (1, 1), (60, 100), (0, 0)])
def test_binomial(spark, wins, n):
    want = 1.0 if n == 0 else min(1.0, sum(math.comb(n, k) for k in range(n + 1) if abs(k - n / 2) >= abs(wins - n / 2)) / 2**n)
    assert one(spark, st.binomial_p_two_sided(F.lit(wins), F.lit(n))) == pytest.approx(want, rel=1e-9)
