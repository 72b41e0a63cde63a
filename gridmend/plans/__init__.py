"""Named queries over the test tables, each with the SQL that it is held against."""

from . import assessment, built, contracts, geography, learned, models, more, restoration, simulated, stored, streamed, tables
from .catalog import QUERIES

__all__ = ["QUERIES", "assessment", "built", "contracts", "geography", "learned", "models", "more", "restoration", "simulated", "stored", "streamed", "tables"]
