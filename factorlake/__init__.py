"""factorlake: multi-factor screening and point-in-time evaluation on Spark."""

from .session import build_session, stable

__all__ = ["build_session", "stable"]
