"""What any clustering of the accounts must satisfy, in a form that SQL can state too."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import CrmModel
from .clustering import (Clustering, cluster_accounts, cluster_pca, cluster_profile, cluster_sector_crosstab,
                         cluster_sector_mix, elbow)
from .features import NUMERIC_FEATURES, feature_names, materialised_features, scaled_features


def feature_matrix_long(model: CrmModel, digits: int | None = None) -> DataFrame:
    """Q25 as (account, slot, value), one row a slot of each account's vector."""
    matrix, fitted = scaled_features(materialised_features(model))
    names = F.array(*[F.lit(n) for n in feature_names(fitted)])
    long = matrix.select("account", F.posexplode(vector_to_array("features")).alias("i", "value"))
    value = F.col("value") if digits is None else F.round("value", digits) + F.lit(0.0)
    return long.select("account", F.element_at(names, F.col("i") + 1).alias("slot"), value.alias("value"))


def cluster_audit(model: CrmModel, clustering: Clustering | None = None, digits: int = 4) -> DataFrame:
    """(audit, item, value): totals of the reports over all clusters, and 1.0 for what must hold.

    accounts: summed cluster sizes; sector: summed counts; weighted_mean: size-weighted
    cluster means; wcss_k1: the closed form; elbow_falls: no larger k is worse than k = 1;
    shares_sum_to_one: every cluster's sector shares; pca_centred, pca_variance: the
    components' mean is 0 and their variance the explained ratio of all variance.
    """
    c = clustering or cluster_accounts(model)
    profile = cluster_profile(model, clustering=c)
    mix = cluster_sector_mix(model, clustering=c)
    shares = cluster_sector_crosstab(model, normalise=True, clustering=c)
    sectors = [x for x in shares.columns if x != "cluster"]
    points, ratios = cluster_pca(model, clustering=c)
    scan = elbow(model, k_max=4, matrix=c.matrix)

    def rows(df: DataFrame, audit: str, item, value) -> DataFrame:
        item = F.lit(item) if isinstance(item, str) else item
        return df.select(F.lit(audit).alias("audit"), item.alias("item"), value.cast("double").alias("value"))

    holds = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    size = F.sum("size")
    weighted = lambda x: F.round(F.sum(F.col(f"mean_{x}") * F.col("size")) / size, digits)
    means = profile.agg(*[weighted(x).alias(x) for x in NUMERIC_FEATURES]) \
        .unpivot([], list(NUMERIC_FEATURES), "item", "value")
    row_sums = shares.select(sum((F.col(f"`{x}`") for x in sectors), F.lit(0.0)).alias("s"))
    spread = points.agg(*[f(f"PC{i}").alias(f"{n}{i}") for i in (1, 2)
                          for n, f in (("m", F.avg), ("v", F.var_pop))])
    total = c.matrix.select(F.posexplode(vector_to_array("features")).alias("i", "x")) \
        .groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("total"))
    named = ratios.select(F.col("component").alias("i"), F.col("explained_variance_ratio").alias("ratio"))
    pcs = spread.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i in (1, 2)]))
        .alias("p")).select("p.*").join(named, "i").crossJoin(total)
    pc_name = F.concat(F.lit("PC"), F.col("i").cast("string"))
    parts = [
        rows(profile.agg(size.alias("n")), "accounts", "all", F.col("n")),
        rows(scan.filter("k = 1"), "wcss_k1", "all", F.round("wcss", 3)),
        rows(scan.agg(F.max(F.when(F.col("k") > 1, F.col("wcss"))).alias("rest"),
                      F.max(F.when(F.col("k") == 1, F.col("wcss"))).alias("one")),
             "elbow_falls", "all", holds(F.col("rest") <= F.col("one"))),
        rows(mix.filter("sector IS NOT NULL").groupBy("sector").agg(F.sum("n").alias("n")), "sector",
             F.col("sector"), F.col("n")),
        rows(means, "weighted_mean", F.col("item"), F.col("value")),
        rows(row_sums.agg(F.max(F.abs(F.col("s") - 1.0)).alias("gap")), "shares_sum_to_one", "all",
             holds(F.col("gap") < 1e-9)),
        rows(pcs, "pca_centred", pc_name, holds(F.abs("m") < 1e-6)),
        rows(pcs, "pca_variance", pc_name, holds(F.abs(F.col("v") - F.col("ratio") * F.col("total")) < 1e-6)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
