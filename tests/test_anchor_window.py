"""Interpolation from more than two anchors and from all of them."""

import numpy as np
import pytest

from contourlake.operators.correct import interpolated

T = np.arange(9.0)
F = np.array([100.0, 130.0, 90.0, 140.0, 0.0, 150.0, 120.0, 170.0, 110.0])
FREE = np.flatnonzero(F > 0)


@pytest.mark.parametrize("anchors", [4, 6, -1])
def test_linear_fits_a_line_through_the_window(anchors):
    chosen = T == 4
    near = FREE if anchors == -1 else FREE[np.argsort(np.abs(T[FREE] - 4), kind="stable")[:anchors]]
    slope, start = np.polyfit(T[near], F[near], 1)
    assert interpolated(T, F, chosen, "interpolate_linear", anchors)[4] == pytest.approx(start + 4 * slope)


def test_all_anchors_and_few_anchors():
    want = np.polyval(np.polyfit(T[FREE], F[FREE], 2), 4)
    assert interpolated(T, F, T == 4, "interpolate_parabola", -1)[4] == pytest.approx(want)
    assert interpolated(T, F, T == 4, "interpolate_linear", 2)[4] == pytest.approx((F[3] + F[5]) / 2)
    three = np.where(np.isin(T, [3, 5, 6]), F, 0.0)
    line = np.polyval(np.polyfit([3, 5, 6], F[[3, 5, 6]], 1), 4)
    assert interpolated(T, three, T == 4, "interpolate_spline", -1)[4] == pytest.approx(line)
