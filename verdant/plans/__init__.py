"""One query for each operator, and the SQL that gives the same rows."""

from . import cycles, files, filters, more, streams  # noqa: F401  they add to QUERIES and ORACLES
from .queries import ORACLES, QUERIES  # noqa: F401
