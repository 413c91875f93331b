"""Session settings: defaults, then the ini file named by VESPERA_CONFIG, then VESPERA_<KEY> variables."""

from __future__ import annotations

import logging
import os
from pathlib import Path

from pyspark.sql import SparkSession

from vespera.sources.ini import parse_ini

DEFAULTS = {"app_name": "vespera", "log_level": "warn", "adaptive": "true"}
_sealed: dict[str, str] | None = None


def settings(environ=os.environ) -> dict[str, str]:
    found = dict(DEFAULTS)
    if path := environ.get("VESPERA_CONFIG"):
        found |= parse_ini(Path(path).read_text()).get("vespera", {})
    return found | {k[8:].lower(): v for k, v in environ.items() if k.startswith("VESPERA_") and k != "VESPERA_CONFIG"}


def session() -> SparkSession:
    """The session with the settings of the first call; later calls change nothing."""
    global _sealed
    if _sealed is None:
        _sealed = settings()
        logging.getLogger("vespera").setLevel({"critical": 50, "error": 40, "warn": 30, "info": 20, "trace": 5, "debug": 10}[_sealed["log_level"].lower()])
    builder = SparkSession.builder.appName(_sealed["app_name"]).config("spark.sql.adaptive.enabled", _sealed["adaptive"])
    return builder.getOrCreate()
