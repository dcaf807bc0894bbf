"""All registered queries and their SQL checks."""

import importlib

from noticeflow.catalog.base import ORACLES, QUERIES, Query

MODULES = ("texts", "joins", "state", "payloads", "runs", "settled", "streams", "stored")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
