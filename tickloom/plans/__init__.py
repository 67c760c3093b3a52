"""Registered queries of the core."""

from __future__ import annotations


def registries() -> list:
    from tickloom.plans import accounts, features, ledgers, market, pipeline, research, streams, trading

    return [x.REGISTRY for x in (pipeline, market, features, trading, research, accounts, streams, ledgers)]
