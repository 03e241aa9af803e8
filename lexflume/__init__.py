"""lexflume: a text-retrieval and corpus-processing engine on PySpark DataFrames."""

from lexflume.session import build_session, materialize

__all__ = ["build_session", "materialize"]
