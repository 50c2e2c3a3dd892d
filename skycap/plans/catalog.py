"""Loads every query module and exposes the registry."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from skycap.plans.registry import ORACLE, QUERIES

_MODULES = ["q_grid", "q_retrieval", "q_eval", "q_probe", "q_io", "q_misc", "q_cluster"]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"skycap.plans.{m}")


def all_queries():
    _load()
    return QUERIES


def all_oracle():
    _load()
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["c10_generate_caption"](spark, sf_dir)
