"""The analytic operators: each is ``f(model, **params) -> DataFrame``, lazy."""

from .audit import cluster_audit, feature_matrix_long
from .clustering import (cluster_accounts, cluster_pca, cluster_profile, cluster_sector_crosstab,
                         cluster_sector_mix, elbow)
from .conversion import agent_performance, deal_conversion, sales_cycle_stats, stage_conversion
from .engagement import (contact_cycle, contact_to_purchase, engagement_score, full_health_score, funnel,
                         lead_conversion, sessions)
from .features import account_features, feature_matrix
from .hierarchy import parent_revenue
from .market import (geographic_performance, industry_penetration, industry_performance,
                     regional_ratio)
from .product import cross_sell, product_penetration, product_performance
from .profile import column_profile, customer_360, touchpoints
from .repeat_buying import expected_clv
from .retention import (churn_status, cohort_retention, cohort_retention_long, period_retention,
                        purchase_counts, repeat_purchase_rate)
from .segmentation import churn_risk, health_score, rfm_segments, value_segments
from .sketches import approx_summary
from .survival import churn_probability, hazard_table
from .value import (acquisition_cost_proxy, average_order_value, customer_lifetime_value,
                    discounted_clv, predicted_clv)

__all__ = [
    "account_features", "acquisition_cost_proxy", "agent_performance", "approx_summary", "average_order_value",
    "churn_probability", "churn_risk", "churn_status", "cluster_accounts", "cluster_audit", "cluster_pca", "cluster_profile",
    "cluster_sector_crosstab", "cluster_sector_mix", "cohort_retention", "cohort_retention_long", "column_profile",
    "contact_cycle", "contact_to_purchase", "cross_sell", "customer_360", "customer_lifetime_value", "deal_conversion", "discounted_clv",
    "elbow", "engagement_score", "expected_clv", "feature_matrix", "feature_matrix_long", "full_health_score", "funnel", "geographic_performance", "hazard_table", "health_score", "industry_penetration",
    "industry_performance", "lead_conversion", "parent_revenue", "period_retention", "predicted_clv", "product_penetration",
    "product_performance", "purchase_counts", "regional_ratio", "repeat_purchase_rate",
    "rfm_segments", "sales_cycle_stats", "sessions", "stage_conversion", "touchpoints", "value_segments",
]
