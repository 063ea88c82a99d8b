"""tidelog: log and event processing as Spark DataFrame operators."""

from tidelog.session import build_session, configure

__all__ = ["build_session", "configure"]
