"""All registered queries."""
from . import corpus, detection, learning, live, statistics, telemetry  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
