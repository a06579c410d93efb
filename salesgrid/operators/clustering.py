"""Account clustering: elbow scan, K-means labels, profiles, sector mix, PCA.

The scaled matrix is checkpointed once and reused by every fit on it; Spark's
K-means and PCA run distributed and only centres, costs and loadings reach
the driver. Nothing is kept between calls: a caller who wants several reports
from one fit holds a ``Clustering`` and passes it on, and releases it at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import ranking
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from .features import PROFILE_FEATURES, materialised_features, scaled_features

DEFAULT_K = 4
DEFAULT_SEED = 42
MAX_ITER = 300
# Relative tolerance of the original fit: stop when the summed squared shift
# of all centres is at most TOL times the mean feature variance.
TOL = 1e-4


@dataclass
class Clustering:
    features: DataFrame     # Q24 rows
    matrix: DataFrame       # account, features (scaled vector)
    kmeans: KMeansModel
    labels: DataFrame       # account, cluster

    def release(self) -> None:
        """Drop the cached matrix (the checkpoint files follow the session's cleaner)."""
        self.matrix.unpersist()


# Partitions of the scaled matrix. Spark's K-means draws its first centres per
# partition, so the fit depends on the layout: it is part of the model, like
# the seed, and not derived from the data's size or the session's settings.
MATRIX_PARTITIONS = 32
# Scaled values are rounded to so many decimals, so that the order in which a
# mean was summed up cannot reach the fit.
MATRIX_DECIMALS = 9


def prepare_matrix(features: DataFrame, partitions: int = MATRIX_PARTITIONS) -> DataFrame:
    """Scaled vectors of materialised feature rows, checkpointed and cached for the fits.

    The same seed gives the same fit only if every partition holds the same
    rows in the same order. So the matrix is hash-partitioned by account into
    ``partitions`` and sorted by account inside each. On a large cluster, raise
    ``partitions`` once, for all fits that are to be compared.
    """
    matrix, _ = scaled_features(features)
    rounded = F.transform(vector_to_array("features"), lambda x: F.round(x, MATRIX_DECIMALS))
    matrix = matrix.select("account", array_to_vector(rounded).alias("features"))
    matrix = matrix.repartition(partitions, "account").sortWithinPartitions("account")
    return reliable_checkpoint(matrix).cache()


def _moments(matrix: DataFrame) -> tuple[int, list[float]]:
    """Row count and per-column sample variances (one distributed pass)."""
    s = matrix.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s"))
    row = s.select("s.variance", "s.count").first()
    return int(row["count"]), [float(v) for v in row["variance"].toArray()]


def total_sum_of_squares(matrix: DataFrame) -> float:
    """WCSS for k = 1: squared distances to the overall mean (closed form)."""
    n, var = _moments(matrix)
    return float(sum(var) * (n - 1)) if n > 1 else 0.0


def spark_tolerance(mean_variance: float, k: int, tol: float = TOL) -> float:
    """Spark's per-centre movement bound that implies the relative stopping rule.

    Spark stops when every centre moved by at most ``eps``; if each squared
    shift is at most ``tol * mean_variance / k``, their sum is at most
    ``tol * mean_variance``.
    """
    return max((tol * mean_variance / k) ** 0.5, 1e-12)


def _kmeans(k: int, seed: int, mean_variance: float = 1.0) -> KMeans:
    return KMeans(k=k, seed=seed, maxIter=MAX_ITER, tol=spark_tolerance(mean_variance, k),
                  featuresCol="features", predictionCol="cluster")


def _mean_population_variance(matrix: DataFrame) -> float:
    n, var = _moments(matrix)
    return (sum(var) / len(var)) * ((n - 1) / n) if n > 1 and var else 1.0


def elbow(model: CrmModel, k_max: int = 10, seed: int = DEFAULT_SEED,
          matrix: DataFrame | None = None, parallel_fits: int = 4) -> DataFrame:
    """Q26: within-cluster sum of squares for k = 1..k_max (k = 1 in closed form)."""
    own = matrix is None
    if own:
        matrix = prepare_matrix(materialised_features(model))
    n, var = _moments(matrix)
    mean_var = (sum(var) / len(var)) * ((n - 1) / n) if n > 1 and var else 1.0

    def cost(k: int) -> float:
        return float(_kmeans(k, seed, mean_var).fit(matrix).summary.trainingCost)

    # The fits are independent: submit them concurrently so their (small,
    # iterative) jobs share the executors instead of running back to back.
    with ThreadPoolExecutor(max_workers=max(1, min(parallel_fits, k_max - 1))) as pool:
        costs = list(pool.map(cost, range(2, k_max + 1)))
    if own:
        matrix.unpersist()
    wcss1 = float(sum(var) * (n - 1)) if n > 1 else 0.0
    rows = [(1, wcss1)] + list(zip(range(2, k_max + 1), costs))
    return matrix.sparkSession.createDataFrame(rows, "k int, wcss double")


def cluster_accounts(model: CrmModel, k: int = DEFAULT_K, seed: int = DEFAULT_SEED,
                     partitions: int = MATRIX_PARTITIONS) -> Clustering:
    """Fit K-means on the scaled matrix; labels keep the account key (no positional join).

    Like the original analysis, which fits once and reports sizes, profiles,
    sector mix and the PCA view from the same labels, pass the result to all reports.
    """
    features = materialised_features(model)
    matrix = prepare_matrix(features, partitions)
    km = _kmeans(k, seed, _mean_population_variance(matrix)).fit(matrix)
    labels = reliable_checkpoint(
        km.transform(matrix).select("account", F.col("cluster").cast("int").alias("cluster")))
    return Clustering(features, matrix, km, labels)


def cluster_profile(model: CrmModel, k: int = DEFAULT_K, seed: int = DEFAULT_SEED,
                    clustering: Clustering | None = None) -> DataFrame:
    """Q27: size and mean / median of the profile features per cluster."""
    c = clustering or cluster_accounts(model, k, seed)
    f = c.features.join(c.labels, "account")
    means = f.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.avg(F.col(x).cast("double")).alias(f"mean_{x}") for x in PROFILE_FEATURES])
    med = ranking.percentiles(f, list(PROFILE_FEATURES), [0.5], group_cols=["cluster"])
    med_wide = med.groupBy("cluster").agg(*[
        F.max(F.when(F.col("column") == x, F.col("value"))).alias(f"median_{x}")
        for x in PROFILE_FEATURES])
    out = means.join(med_wide, "cluster", "left")
    return out.orderBy("cluster")


def cluster_sector_mix(model: CrmModel, k: int = DEFAULT_K, seed: int = DEFAULT_SEED,
                       clustering: Clustering | None = None) -> DataFrame:
    """Q28: accounts per cluster and sector, and the sector's share within the cluster."""
    c = clustering or cluster_accounts(model, k, seed)
    f = c.features.join(c.labels, "account")
    g = f.groupBy("cluster", "sector").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("cluster")).cast("double")
    return g.select("cluster", "sector", "n", share.alias("proportion")).orderBy("cluster", "sector")


def cluster_sector_crosstab(model: CrmModel, k: int = DEFAULT_K, seed: int = DEFAULT_SEED,
                            normalise: bool = False, clustering: Clustering | None = None,
                            sectors: Sequence[str] | None = None) -> DataFrame:
    """Cluster x sector table, one column per sector (counts, or row shares).

    Accounts without a sector are left out, as in the original. ``sectors``
    names the columns; by default they are the sectors of the features (one
    small job, sorted). Missing combinations are 0.
    """
    c = clustering or cluster_accounts(model, k, seed)
    f = c.features.join(c.labels, "account").filter(F.col("sector").isNotNull())
    if sectors is None:
        sectors = sorted(r.sector for r in f.select("sector").distinct().collect())
    wide = f.groupBy("cluster").pivot("sector", list(sectors)).agg(F.count(F.lit(1))).na.fill(0)
    if normalise and sectors:
        total = sum((F.col(f"`{x}`") for x in sectors[1:]), F.col(f"`{sectors[0]}`"))
        wide = wide.select("cluster", *[C.ratio(F.col(f"`{x}`"), total).alias(x) for x in sectors])
    return wide.orderBy("cluster")


def cluster_pca(model: CrmModel, k: int = DEFAULT_K, seed: int = DEFAULT_SEED,
                components: int = 2, clustering: Clustering | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """Q29: 2-D projection of the scaled matrix with cluster labels, and explained variance.

    The matrix is already centred by the scaler, so Spark's non-centring PCA
    transform gives the same coordinates (up to sign) as a centring one.
    """
    c = clustering or cluster_accounts(model, k, seed)
    pca: PCAModel = PCA(k=components, inputCol="features", outputCol="_pc").fit(c.matrix)
    proj = c.kmeans.transform(pca.transform(c.matrix))
    arr = vector_to_array(F.col("_pc"))
    points = proj.select("account", *[arr[i].alias(f"PC{i + 1}") for i in range(components)],
                         F.col("cluster").cast("int").alias("cluster"))
    ratios = [float(v) for v in pca.explainedVariance.toArray()]
    cum, acc = [], 0.0
    for r in ratios:
        acc += r
        cum.append(acc)
    variance = c.matrix.sparkSession.createDataFrame(
        [(i + 1, r, cu) for i, (r, cu) in enumerate(zip(ratios, cum))],
        "component int, explained_variance_ratio double, cumulative_ratio double")
    return points, variance
