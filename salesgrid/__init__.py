"""salesgrid: customer and sales-pipeline analytics as Spark DataFrame jobs."""

from .plans.model import CrmModel, crm_view
from .session import build_session, ensure_checkpoint_dir

__all__ = ["CrmModel", "crm_view", "build_session", "ensure_checkpoint_dir"]
