"""The rules that suggest k, and average linkage."""

import numpy as np

from contourlake.operators import cluster as C
from contourlake.operators import lloyd as L


def test_gap_takes_the_first_k_within_one_standard_error(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, silhouette double, mdl double, gap double, gap_se double, bic double")
    one = C.suggestions(make([(2, 0.5, 9.0, 0.10, 0.01, -9.0), (3, 0.6, 8.0, 0.50, 0.01, -8.0), (4, 0.4, 7.0, 0.52, 0.05, -5.0), (5, 0.3, 6.0, 0.60, 0.01, -6.0)])).first()
    assert (one.k_silhouette, one.k_mdl, one.k_gap, one.k_gmm, one.k_auto) == (3, 5, 3, 4, 4)
    rising = C.suggestions(make([(2, 0.5, 9.0, 0.1, 0.0, None), (3, 0.6, 8.0, 0.5, 0.0, None)])).first()
    assert (rising.k_gap, rising.k_gmm, rising.k_auto) == (3, None, 3)


def vectors(spark, points):
    return spark.createDataFrame([(str(i), list(map(float, p))) for i, p in enumerate(points)], "token string, features array<double>")


def test_mixture_finds_three_groups(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1.0, (60, 2)) for c in ((0, 0), (20, 0), (0, 20))])
    assert C.mixture_table(vectors(spark, points), (2, 3, 4), starts=5).orderBy(C.F.desc("bic")).first().k == 3


def test_average_linkage_counts_the_scatter_of_groups():
    """Two wide groups with near centres are farther apart, pair by pair, than two tight ones with centres a bit farther."""
    sizes, centres, scatter = np.array([4, 4, 2, 2]), np.array([(0.5, 0.0), (8.5, 0.0), (200.0, 0.5), (215.0, 0.5)]), np.array([900.25, 900.25, 0.25, 0.25])
    merges = L.merge_order(sizes, centres, scatter, "average")
    assert L.cut_merges(4, merges, 3).tolist() == [0, 1, 2, 2]
    assert L.cut_merges(4, L.merge_order(sizes, centres, scatter, "ward"), 3).tolist() == [0, 0, 1, 2]
