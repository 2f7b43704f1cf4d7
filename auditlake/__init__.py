"""auditlake: table auditing, profiling, retrieval and usage analytics as Spark jobs."""

from auditlake.session import build_session

__all__ = ["build_session"]
