"""Invariants of the clustering operators (no SQL oracle: labels depend on initialisation)."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from salesgrid.operators import clustering as K
from salesgrid.operators.features import account_features, scaled_features

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")


@pytest.fixture(scope="module")
def model(spark):
    return E.model_for(spark, SF)


@pytest.fixture(scope="module")
def clustering(model):
    return K.cluster_accounts(model, k=4, seed=42)


def test_scaled_columns_have_zero_mean_unit_population_std(model):
    feats = account_features(model)
    matrix, _ = scaled_features(feats)
    x = np.array([r.features.toArray() for r in matrix.collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9)
    std = x.std(axis=0)
    assert np.all((np.abs(std - 1) < 1e-9) | (std < 1e-12))


def test_elbow_k1_closed_form_and_shape(model):
    matrix = K.prepare_matrix(account_features(model))
    n = matrix.count()
    d = len(matrix.first().features)
    out = K.elbow(model, k_max=4, matrix=matrix).collect()
    assert [r.k for r in out] == [1, 2, 3, 4]
    assert out[0].wcss == pytest.approx(n * d, rel=1e-9)
    assert K.total_sum_of_squares(matrix) == pytest.approx(out[0].wcss, rel=1e-12)
    assert all(r.wcss <= out[0].wcss + 1e-6 for r in out)


def test_one_hot_width_matches_categories(model):
    feats = account_features(model)
    matrix, fitted = scaled_features(feats)
    from salesgrid.operators.features import feature_names
    names = feature_names(fitted)
    sectors = feats.select("sector").distinct().count()
    offices = feats.select("office_location").distinct().count()
    assert len(matrix.first().features) == len(names) == 8 + sectors + offices


def test_cluster_sizes_and_profile(clustering, model):
    n = clustering.features.count()
    prof = K.cluster_profile(model, clustering=clustering).collect()
    assert sum(r.size for r in prof) == n
    assert len(prof) <= 4
    for r in prof:
        assert r.median_total_deals is not None and r.mean_win_rate is not None


def test_sector_mix_proportions_sum_to_one(clustering, model):
    mix = K.cluster_sector_mix(model, clustering=clustering)
    sums = mix.groupBy("cluster").agg(F.sum("proportion").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_pca_variance_and_points(clustering, model):
    points, var = K.cluster_pca(model, clustering=clustering)
    v = [r.explained_variance_ratio for r in var.orderBy("component").collect()]
    assert len(v) == 2 and 0 < v[1] <= v[0] <= 1
    assert points.count() == clustering.features.count()
    assert points.filter(F.col("cluster").isNull()).count() == 0


def _labels(c):
    return {r.account: r.cluster for r in c.labels.collect()}


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_labels_and_costs_do_not_depend_on_settings_or_row_order(spark, clustering, model, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        shuffled = K.materialised_features(model).orderBy(F.xxhash64(F.lit(int(partitions)), "account"))
        matrix = K.prepare_matrix(shuffled.repartition(int(partitions) + 1))
        km = K._kmeans(4, 42, K._mean_population_variance(matrix)).fit(matrix)
        labels = {r.account: r.cluster for r in km.transform(matrix).collect()}
        costs = [r.wcss for r in K.elbow(model, k_max=3, matrix=matrix).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert labels == _labels(clustering)
    assert costs == pytest.approx([r.wcss for r in K.elbow(model, k_max=3, matrix=clustering.matrix).collect()],
                                  rel=1e-12)


def test_missing_feature_values_are_named_or_filled(model):
    features = K.materialised_features(model)
    holed = features.withColumn("avg_days_close_deal", F.when(F.col("account") > "Customer#000000050",
                                                              F.col("avg_days_close_deal")))
    with pytest.raises(ValueError, match="avg_days_close_deal"):
        scaled_features(holed)
    matrix, _ = scaled_features(holed, fill={"avg_days_close_deal": 0.0})
    assert not np.isnan(np.array([r.features.toArray() for r in matrix.collect()])).any()


def test_accounts_without_a_sector_are_left_out_of_the_crosstab(spark, clustering, model):
    holed = clustering.features.withColumn("sector", F.when(F.col("company_age") % 2 == 0, F.col("sector")))
    c = K.Clustering(holed, clustering.matrix, clustering.kmeans, clustering.labels)
    wide = K.cluster_sector_crosstab(model, clustering=c)
    assert "NULL" not in wide.columns
    total = sum(v for r in wide.collect() for k, v in r.asDict().items() if k != "cluster")
    assert total == holed.filter("sector IS NOT NULL").count()


def test_sector_crosstab_matches_long_form(clustering, model):
    wide = K.cluster_sector_crosstab(model, clustering=clustering).collect()
    long = {(r.cluster, r.sector): r.n for r in K.cluster_sector_mix(model, clustering=clustering).collect()}
    for r in wide:
        for sector, n in r.asDict().items():
            if sector != "cluster":
                assert n == long.get((r.cluster, sector), 0)
    norm = K.cluster_sector_crosstab(model, normalise=True, clustering=clustering).collect()
    for r in norm:
        assert sum(v for k_, v in r.asDict().items() if k_ != "cluster") == pytest.approx(1.0)
