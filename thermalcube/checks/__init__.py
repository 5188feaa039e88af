"""Queries of every operator over the given tables, each paired with independent SQL."""

from thermalcube.checks import cube, functions, sources, staging, warehouse  # noqa: F401
from thermalcube.checks.registry import ORACLES, QUERIES  # noqa: F401
