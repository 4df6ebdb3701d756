"""Registered queries of the engine and their SQL."""

from acervo.checks import inputs, lifecycles, reports, requests, retrievals, texts  # noqa: F401
from acervo.checks import pipelines, streams  # noqa: F401
from acervo.checks.registry import CHECKS, Tables

__all__ = ["CHECKS", "Tables"]
