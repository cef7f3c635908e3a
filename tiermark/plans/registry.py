"""Registered queries and their SQL."""

from tiermark.plans.oracles import ORACLE_SQL  # noqa: F401
from tiermark.plans.queries import QUERIES  # noqa: F401
