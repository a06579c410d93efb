"""The CRM star model: fact + three dimensions, and the joined view (Q0).

Metrics ask the model for the narrow set of fact columns they read and for
the dimensions they need, instead of scanning the four-way joined view.
Because dimension keys are unique (see ``sources.catalog.check_keys``), a
metric grouped by a dimension attribute can aggregate the fact table by the
dimension key first and join the much smaller result afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PIPELINE_COLUMNS, VIEW_DIMENSION_COLUMNS

AGENT_KEY = "_agent_key"
ACCOUNT_KEY = "_account_key"


class CrmModel:
    def __init__(self, pipeline: Callable[[tuple[str, ...]], DataFrame] | DataFrame,
                 accounts: Callable[[], DataFrame] | DataFrame,
                 products: Callable[[], DataFrame] | DataFrame,
                 sales_teams: Callable[[], DataFrame] | DataFrame,
                 view: Callable[[tuple[str, ...]], DataFrame] | None = None,
                 agent_key: tuple[Callable[[tuple[str, ...]], DataFrame],
                                  Callable[[], DataFrame]] | None = None,
                 account_key: tuple[Callable[[tuple[str, ...]], DataFrame],
                                    Callable[[], DataFrame]] | None = None,
                 interactions: Callable[[], DataFrame] | DataFrame | None = None,
                 **params):
        self._pipeline = pipeline
        # optional source-specific builder of the joined view (same result as
        # joining the dimensions on their keys, possibly with fewer shuffles)
        self._view = view
        # optional surrogate agent key: (fact columns + AGENT_KEY, AGENT_KEY -> agent rows)
        self._agent_key = agent_key
        # the same for accounts: (fact columns + keys, ACCOUNT_KEY -> account)
        self._account_key = account_key
        self._dims = {"accounts": accounts, "products": products, "sales_teams": sales_teams}
        # optional: contacts with accounts (account, contact_id, contact_time, channel, value)
        if interactions is not None:
            self._dims["interactions"] = interactions
        # dataset parameters (as-of date, home country, reference year, ...)
        self.params = dict(params)

    # -- constructors -----------------------------------------------------
    @classmethod
    def from_frames(cls, pipeline: DataFrame, accounts: DataFrame, products: DataFrame,
                    sales_teams: DataFrame, interactions: DataFrame | None = None, **params) -> "CrmModel":
        return cls(pipeline, accounts, products, sales_teams, interactions=interactions, **params)

    @classmethod
    def from_tpch(cls, tables, validate_keys: bool = True, **params) -> "CrmModel":
        """The driver's tables as a star; ``validate_keys`` checks the dimension keys first."""
        from ..sources import starmap
        from ..sources.catalog import require_valid_keys
        model = cls(lambda cols: starmap.pipeline_from_tpch(tables, cols),
                    lambda: starmap.accounts_from_tpch(tables),
                    lambda: starmap.products_from_tpch(tables),
                    lambda: starmap.sales_teams_from_tpch(tables),
                    view=lambda cols: starmap.star_from_tpch(tables, cols),
                    agent_key=(lambda cols: starmap.star_from_tpch(tables, (AGENT_KEY, *cols)),
                               lambda: starmap.agents_by_key(tables)),
                    account_key=(lambda cols: starmap.star_from_tpch(tables, (ACCOUNT_KEY, *cols)),
                                 lambda: starmap.accounts_by_key(tables)),
                    interactions=(lambda: starmap.interactions_from_tpch(tables)) if "events" in tables else None,
                    **params)
        return require_valid_keys(model) if validate_keys else model

    # -- access -------------------------------------------------------------
    @property
    def spark(self):
        return self.pipeline("deal_stage").sparkSession

    def pipeline(self, *columns: str) -> DataFrame:
        cols = tuple(dict.fromkeys(columns)) if columns else PIPELINE_COLUMNS
        if callable(self._pipeline) and not isinstance(self._pipeline, DataFrame):
            return self._pipeline(cols)
        return self._pipeline.select(*cols)

    def _dim(self, name: str) -> DataFrame:
        d = self._dims[name]
        return d() if callable(d) and not isinstance(d, DataFrame) else d

    def accounts(self) -> DataFrame:
        return self._dim("accounts")

    def products(self) -> DataFrame:
        return self._dim("products")

    def sales_teams(self) -> DataFrame:
        return self._dim("sales_teams")

    def interactions(self) -> DataFrame:
        if "interactions" not in self._dims:
            raise ValueError("the model has no interactions")
        return self._dim("interactions")

    def agent_keyed_pipeline(self, *columns: str) -> DataFrame:
        """Fact columns plus ``AGENT_KEY``, a surrogate for ``sales_agent``.

        Grouping by the surrogate and naming afterwards (``agent_names``)
        moves only aggregated rows to the agents' table. Without a source
        surrogate the key is the agent name itself.
        """
        if self._agent_key is not None:
            return self._agent_key[0](tuple(columns))
        return self.pipeline("sales_agent", *columns).withColumnRenamed("sales_agent", AGENT_KEY)

    def account_keyed_pipeline(self, *columns: str) -> DataFrame:
        """Fact columns (``AGENT_KEY`` among them, if wanted) plus ``ACCOUNT_KEY``.

        Aggregating by the key and naming afterwards (``account_names``) joins
        aggregated rows only with the accounts' names.
        """
        if self._account_key is not None:
            return self._account_key[0](tuple(columns))
        cols = ["sales_agent" if c == AGENT_KEY else c for c in columns]
        return self.pipeline("account", *cols).withColumnRenamed("account", ACCOUNT_KEY) \
            .withColumnRenamed("sales_agent", AGENT_KEY)

    def account_names(self, keyed: DataFrame) -> DataFrame:
        """``account`` instead of ``ACCOUNT_KEY``. Keys without a name all become NULL,
        so rows of one account (that of NULL) may have to be merged again.
        """
        if self._account_key is not None:
            return keyed.join(self._account_key[1](), ACCOUNT_KEY, "left").drop(ACCOUNT_KEY)
        return keyed.withColumnRenamed(ACCOUNT_KEY, "account")

    def agent_names(self, keyed: DataFrame) -> DataFrame:
        """Attach sales_agent, manager and regional_office to rows carrying ``AGENT_KEY``.

        Exactly what joining the fact rows to the sales teams would give: an
        unmatched key keeps its own name when the key is the name, and has no
        name when the key is a surrogate.
        """
        if self._agent_key is not None:
            agents = self._agent_key[1]()
            return keyed.join(agents, AGENT_KEY, "left").drop(AGENT_KEY)
        teams = self.sales_teams().select(F.col("sales_agent").alias(AGENT_KEY),
                                          "manager", "regional_office")
        return (keyed.join(teams, AGENT_KEY, "left")
                .withColumnRenamed(AGENT_KEY, "sales_agent"))

    def param(self, name: str, default=None):
        return self.params.get(name, default)


def crm_view(model: CrmModel, columns: Iterable[str] | None = None) -> DataFrame:
    """Q0: pipeline LEFT JOIN sales_teams LEFT JOIN products LEFT JOIN accounts.

    Joining on column names keeps one copy of each key (the pipeline's), which
    is what bare names mean in the original view. Dimensions whose columns are
    not requested are not joined (keys are unique, so that is exact).

    Which join comes first does not matter to the result, but what a join adds
    travels in the shuffles of those after it. So the products come first (two
    columns to go through the accounts' shuffle, not six through the products')
    and the sales teams, the smallest dimension and the likeliest broadcast, last.
    """
    wanted = list(columns) if columns else (
        list(PIPELINE_COLUMNS) + [c for cs in VIEW_DIMENSION_COLUMNS.values() for c in cs])
    if model._view is not None:
        return model._view(tuple(wanted))
    fact_cols = [c for c in PIPELINE_COLUMNS if c in wanted]
    need = {dim: [c for c in cols if c in wanted] for dim, cols in VIEW_DIMENSION_COLUMNS.items()}
    keys = {"sales_teams": "sales_agent", "products": "product", "accounts": "account"}
    for dim, cols in need.items():
        if cols and keys[dim] not in fact_cols:
            fact_cols.append(keys[dim])
    df = model.pipeline(*fact_cols)
    for dim in ("products", "accounts", "sales_teams"):
        if need[dim]:
            d = model._dim(dim).select(keys[dim], *need[dim])
            df = df.join(d, keys[dim], "left")
    return df.select(*wanted)
