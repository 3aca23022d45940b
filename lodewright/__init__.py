"""lodewright: a Spark-first analytics engine with PostgreSQL-style semantics."""

from lodewright.session import get_session
from lodewright.storage import drop_intermediates, materialize, shared_dir

__all__ = ["drop_intermediates", "get_session", "materialize", "shared_dir"]
