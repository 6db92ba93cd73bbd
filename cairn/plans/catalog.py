"""All queries of the library, by importing the modules that register them."""

from cairn.plans import learned, ranking, records, relational, rules, serving, streams, training  # noqa: F401
from cairn.plans.registry import COVERS, ORACLE, QUERIES, covered  # noqa: F401
