"""Every operator as a query over the given tables, each with the SQL that must give the same rows."""

from . import cleaning, files, profile, streams
from .registry import CHECKS

__all__ = ["CHECKS", "cleaning", "files", "profile", "streams"]
