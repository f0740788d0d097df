"""Imports every query module and exposes the complete registry."""

from stationflow.plans import (  # noqa: F401
    demand_queries,
    inventory_queries,
    model_queries,
    trip_queries,
    weather_queries,
)
from stationflow.plans.registry import QUERIES  # noqa: F401
