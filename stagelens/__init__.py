"""stagelens: scoring and comparing ticketed events on Spark."""

from stagelens.session import build_session, materialize, tune

__all__ = ["build_session", "materialize", "tune"]
