"""A Spark-native SQL analytics engine."""

from quillon.errors import BindError, CatalogError, EngineError, ParseError, UnsupportedStatement
from quillon.session import Engine

__all__ = ["BindError", "CatalogError", "Engine", "EngineError", "ParseError", "UnsupportedStatement"]
