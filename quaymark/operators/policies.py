"""Policies: functions from requests and artifacts to decisions, under a name.

A policy takes requests (key and whatever it reads) and a mapping of named
tables, and gives key, model_name: one row for each request it can decide.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators.joins import small
from quaymark.operators.matrix import argmax_first
from quaymark.operators.rules import alpha_sweep, dollar_sweep
from quaymark.operators.splits import random_policy

Artifacts = Mapping[str, DataFrame]
Policy = Callable[[DataFrame, Artifacts], DataFrame]

_POLICIES: dict[str, Policy] = {}


def policy(name: str) -> Callable[[Policy], Policy]:
    """Puts a policy under a name; a name is given once."""

    def wrap(fn: Policy) -> Policy:
        if name in _POLICIES:
            raise ValueError(f"policy {name} is there already")
        _POLICIES[name] = fn
        return fn

    return wrap


def names() -> list[str]:
    return sorted(_POLICIES)


def decide(name: str, requests: DataFrame, artifacts: Artifacts) -> DataFrame:
    """key, model_name of the named policy."""
    if name not in _POLICIES:
        raise KeyError(f"no policy {name}; there are {', '.join(names())}")
    return _POLICIES[name](requests, artifacts).select("key", "model_name")


@policy("random")
def _random(requests: DataFrame, artifacts: Artifacts) -> DataFrame:
    """A model by the hash of the key; ``models``: ord from 0, model_name."""
    n = artifacts["models"].count()  # a roster
    return requests.select("key", random_policy(F.col("key"), 7, n).alias("ord")).join(small(artifacts["models"].select(F.col("ord").cast("long").alias("ord"), "model_name")), "ord")


def _fixed(requests: DataFrame, single: DataFrame) -> DataFrame:
    return requests.select("key").crossJoin(F.broadcast(single))  # one row


@policy("best_single")
def _best_single(requests: DataFrame, artifacts: Artifacts) -> DataFrame:
    """The model of the best mean score in ``outcomes``."""
    per = artifacts["outcomes"].groupBy("model_name").agg(F.avg("score").alias("s"))
    return _fixed(requests, per.agg(F.min_by("model_name", F.struct(-F.round("s", 9), "model_name")).alias("model_name")))


@policy("cheapest")
def _cheapest(requests: DataFrame, artifacts: Artifacts) -> DataFrame:
    """The model of the lowest mean cost in ``outcomes``."""
    per = artifacts["outcomes"].groupBy("model_name").agg(F.avg("cost").alias("c"))
    return _fixed(requests, per.agg(F.min_by("model_name", F.struct(F.round("c", 9), "model_name")).alias("model_name")))


@policy("best_estimate")
def _best_estimate(requests: DataFrame, artifacts: Artifacts) -> DataFrame:
    """The highest of ``estimates`` (key, model_name, value)."""
    return argmax_first(artifacts["estimates"].join(requests.select("key"), "key", "left_semi"), ["key"])


@policy("alpha")
def _alpha(requests: DataFrame, artifacts: Artifacts, alpha: float = 0.5) -> DataFrame:
    """Half quality, half cheapness, of ``estimates`` and ``cost_norm``."""
    return alpha_sweep(artifacts["estimates"].join(requests.select("key"), "key", "left_semi"), artifacts["cost_norm"], "key", (alpha,))


@policy("dollar")
def _dollar(requests: DataFrame, artifacts: Artifacts, rate: float = 20.0) -> DataFrame:
    """``estimates`` less rate times the mean cost in ``cost_hat``."""
    return dollar_sweep(artifacts["estimates"].join(requests.select("key"), "key", "left_semi"), artifacts["cost_hat"], "key", (rate,))
