"""Account features for clustering (Q24) and the scaled feature matrix (Q25)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (ElementwiseProduct, OneHotEncoder, SQLTransformer,
                                StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S

# The clustering feature lists of the original analysis.
NUMERIC_FEATURES = ("revenue", "employees", "company_age", "completed_deals", "failed_deals",
                    "avg_days_close_deal", "total_deals", "win_rate")
CATEGORICAL_FEATURES = ("sector", "office_location")
LOG_FEATURES = ("revenue", "employees")
PROFILE_FEATURES = ("revenue", "employees", "company_age", "completed_deals", "failed_deals",
                    "total_deals", "win_rate", "avg_days_close_deal")

DEFAULT_HOME = "United States"
DEFAULT_REFERENCE_YEAR = 2017


def account_features(model: CrmModel, reference_year: int | None = None,
                     home: str | None = None) -> DataFrame:
    """Q24: per account with closed deals: firmographics and win/loss behaviour.

    Closed deals only (Won, Lost); inner join with accounts, so the NULL
    account and accounts without a closed deal are absent.
    """
    reference_year = reference_year or model.param("reference_year", DEFAULT_REFERENCE_YEAR)
    home = home or model.param("home", DEFAULT_HOME)
    days = C.day_diff("engage_date", "close_date")
    agg = S.per_account(model, ("deal_stage", "engage_date", "close_date"), {
        "_won": ("count", F.when(C.is_won(), 1)), "_lost": ("count", F.when(C.is_lost(), 1)),
        "_days": ("sum", days), "_timed": ("count", days)}, F.col("deal_stage").isin("Won", "Lost"))
    agg = agg.select("account", F.col("_won").cast("double").alias("completed_deals"),
                     F.col("_lost").cast("double").alias("failed_deals"),
                     C.ratio("_days", "_timed").alias("avg_days_close_deal"))
    total = F.col("completed_deals") + F.col("failed_deals")
    agg = agg.select("account", "completed_deals", "failed_deals", "avg_days_close_deal",
                     total.alias("total_deals"),
                     (F.col("completed_deals") / total).alias("win_rate"))
    acc = model.accounts().select(
        "account", "sector",
        (F.lit(int(reference_year)) - F.col("year_established")).alias("company_age"),
        "revenue", "employees",
        F.when(F.col("office_location") == F.lit(home), F.lit("US")).otherwise(F.lit("Non-US"))
        .alias("office_location"))
    j = acc.join(agg, "account", "inner")
    return j.select("account", "sector", "company_age", "revenue", "employees", "office_location",
                    "completed_deals", "failed_deals", "avg_days_close_deal", "total_deals",
                    "win_rate")


def feature_pipeline(numeric: Sequence[str] = NUMERIC_FEATURES,
                     categorical: Sequence[str] = CATEGORICAL_FEATURES,
                     log_features: Sequence[str] = LOG_FEATURES) -> Pipeline:
    """log1p -> one-hot (alphabetical categories, none dropped) -> assemble -> standardise.

    Every assembled column is standardised, one-hot columns included, as in
    the original. Spark divides by the sample deviation; ``scaled_features``
    rescales to the population deviation afterwards.
    """
    logs = ", ".join(f"log1p(`{c}`) AS `{c}`" if c in log_features else f"`{c}`"
                     for c in numeric)
    keep = ", ".join(f"`{c}`" for c in ("account", *categorical))
    stages = [SQLTransformer(statement=f"SELECT {keep}, {logs} FROM __THIS__")]
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    for c, i in zip(categorical, idx):
        stages.append(StringIndexer(inputCol=c, outputCol=i, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
    if categorical:
        # The indexer's "keep" adds one trailing slot for NULL/unseen values;
        # dropping the last slot removes exactly that one, so every seen
        # category keeps its column and NULL encodes as all zeros.
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True,
                                    handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[*numeric, *ohe], outputCol="raw_features",
                                  handleInvalid="error"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="sample_scaled",
                                 withMean=True, withStd=True))
    return Pipeline(stages=stages)


def _complete(features: DataFrame, fill: dict[str, float] | None) -> DataFrame:
    """The features with ``fill`` put in; a numeric column that still has NULLs (or NaN) is an error."""
    if fill:
        features = features.fillna(fill)
    missing = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    counts = features.agg(*[F.count(F.when(missing(c), 1)).alias(c) for c in NUMERIC_FEATURES]).first()
    bad = [c for c in NUMERIC_FEATURES if counts[c]]
    if bad:
        raise ValueError(f"missing values in feature columns: {', '.join(bad)} (see the parameter fill)")
    return features


def scaled_features(features: DataFrame, population_std: bool = True,
                    fill: dict[str, float] | None = None) -> tuple[DataFrame, PipelineModel]:
    """Q25 core: (account, features vector) plus the fitted pipeline.

    The fits read ``features`` several times (indexers, scaler, row count):
    pass a materialised frame (see ``materialised_features``). Numeric columns
    must be complete, since one missing value would spread through its column's
    mean; ``fill`` gives values (column -> number) for missing ones.
    """
    features = _complete(features, fill)
    fitted = feature_pipeline().fit(features)
    out = fitted.transform(features)
    if population_std:
        width = len(feature_names(fitted))
        n = features.count()
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        out = ElementwiseProduct(scalingVec=Vectors.dense([factor] * width),
                                 inputCol="sample_scaled", outputCol="features").transform(out)
    else:
        out = out.withColumnRenamed("sample_scaled", "features")
    return out.select("account", "features"), fitted


def materialised_features(model: CrmModel, **kwargs) -> DataFrame:
    """Q24 rows written once to the checkpoint folder (one row per account)."""
    return reliable_checkpoint(account_features(model, **kwargs))


def feature_matrix(model: CrmModel, **kwargs) -> DataFrame:
    """Q25: account and its scaled feature vector."""
    matrix, _ = scaled_features(materialised_features(model, **kwargs))
    return matrix


def feature_names(fitted: PipelineModel, numeric: Sequence[str] = NUMERIC_FEATURES,
                  categorical: Sequence[str] = CATEGORICAL_FEATURES) -> list[str]:
    """Names of the assembled vector slots, e.g. ``sector_MACHINERY``."""
    names = list(numeric)
    indexers = [s for s in fitted.stages if s.__class__.__name__ == "StringIndexerModel"]
    for c, ind in zip(categorical, indexers):
        names += [f"{c}_{label}" for label in ind.labels]
    return names
