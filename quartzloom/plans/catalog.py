"""All queries of the library, and their SQL."""

from quartzloom.plans import learning, relational  # noqa: F401
from quartzloom.plans.registry import ORACLES, QUERIES  # noqa: F401
