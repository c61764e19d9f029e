"""Stratified classifier evaluation, class balancing and curation on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or
``Column -> Column`` under :mod:`evenhand.functions`) that builds a lazy plan.
"""

from evenhand.schemas import nan_to_null, require_columns
from evenhand.session import new_work_path, reliable_checkpoint

__all__ = ["nan_to_null", "new_work_path", "reliable_checkpoint", "require_columns"]
