"""Analytics over messy tables, expressed as Spark DataFrame plans."""

from gridsense.errors import QueryIssue
from gridsense.plans.intent import Intent
from gridsense.plans.query import Result, run

__all__ = ["Intent", "QueryIssue", "Result", "run"]
