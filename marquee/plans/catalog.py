"""Imports every query module so the registry is complete."""

from __future__ import annotations

from . import q_eval, q_ingest, q_models, q_ops  # noqa: F401
from .registry import ORACLE, QUERIES


def all_queries():
    return QUERIES


def all_oracles():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}


def flagship(spark, sf_dir):
    return QUERIES["hybrid_cb_only"](spark, sf_dir)
