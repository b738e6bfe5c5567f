"""annalist: code-history analytics as Spark DataFrame operators."""

from annalist.schema import History

__all__ = ["History"]
