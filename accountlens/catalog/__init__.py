"""The engine's operators as named queries over the sample tables, with their SQL twins."""

from accountlens.catalog.oracles import ORACLES
from accountlens.catalog.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
