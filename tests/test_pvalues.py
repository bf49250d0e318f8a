"""Special functions against published table values."""

import math

import pytest

from tabprobe.functions import pvalues as pv
from tabprobe.functions.shapiro import shapiro_wilk


@pytest.mark.parametrize("t,dof,p", [(2.0, 10, 0.07339), (2.228, 10, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0)])
def test_t_two_sided(t, dof, p):
    assert abs(pv.t_two_sided(t, dof) - p) < 2e-4


@pytest.mark.parametrize("x,k,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
                                   (18.307038053275146, 10, 0.05), (5.8333, 1, 0.01573)])
def test_chi2_sf(x, k, p):
    assert abs(pv.chi2_sf(x, k) - p) < 1e-4


def test_chi2_two_dof_is_exp():
    for x in (0.1, 1.0, 7.5, 40.0):
        assert math.isclose(pv.chi2_sf(x, 2), math.exp(-x / 2), rel_tol=1e-9)


@pytest.mark.parametrize("f,d1,d2,p", [(3.0, 2, 10, 0.09537), (4.964602743730711, 1, 10, 0.05), (1.0, 5, 5, 0.5)])
def test_f_sf(f, d1, d2, p):
    assert abs(pv.f_sf(f, d1, d2) - p) < 1e-4


def test_norm_sf():
    assert abs(pv.norm_sf(1.959963984540054) - 0.025) < 1e-12


def test_shapiro_behaviour():
    import numpy as np
    rng = np.random.default_rng(42)
    w, p = shapiro_wilk(rng.normal(size=400))
    assert 0.98 < w <= 1 and p > 0.01
    w, p = shapiro_wilk(rng.exponential(size=400))
    assert w < 0.95 and p < 1e-6
    assert shapiro_wilk([1.0, 1.0, 1.0]) == (1.0, 1.0)
    assert math.isnan(shapiro_wilk([1.0, 2.0])[0])
