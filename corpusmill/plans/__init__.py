"""All queries of the library: name -> function, and their SQL."""

from . import curation_queries, export_queries, file_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curation_queries", "export_queries", "file_queries", "stream_queries", "text_queries"]
