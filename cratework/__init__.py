"""cratework: music-catalogue and record-collection analytics as PySpark DataFrames."""

from cratework.session import session

__all__ = ["session"]
