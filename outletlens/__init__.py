"""outletlens: per-outlet order-catalogue analytics on Spark DataFrames."""

from .sources.ledger import Ledger  # noqa: F401

__all__ = ["Ledger"]
