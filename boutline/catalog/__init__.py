"""Registered queries: one DataFrame plan per operator, with its SQL statement where it has one."""

from boutline.catalog import (  # noqa: F401
    evaluating,
    feeds,
    joining,
    modelling,
    reading,
    scalars,
    sequences,
    streaming,
)
from boutline.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
