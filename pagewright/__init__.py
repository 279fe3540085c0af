"""Web-page analytics on Spark: pages become node tables, sessions become event tables."""

from pagewright.session import build_session

__all__ = ["build_session"]
