"""Spark-native audit of traffic to a large-language-model gateway."""

from planewatch.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
