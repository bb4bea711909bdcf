"""All queries on scheduling tables and their SQL; importing the operator modules fills them."""

from ..operators import aggregates, filters, joins, routing, scans, temporal, transitions, windows  # noqa: F401
from ..streaming import folds, lifecycle  # noqa: F401
from .query import ORACLES, QUERIES  # noqa: F401
