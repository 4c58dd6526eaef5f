"""Automated data analysis on Spark: profiling, anomalies, models, drift, documents, events, privacy, sessions."""

from lumenframe.session import build_session, materialise, scratch_path, scratch_scope

__all__ = ["build_session", "materialise", "scratch_path", "scratch_scope"]
