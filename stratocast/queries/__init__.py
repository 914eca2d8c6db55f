"""All registered queries, one module per operator family."""

import importlib

MODULES = ["scans", "filters", "scalars", "joins", "aggregates", "windows", "trading", "strategies", "streams", "datasets", "models"]

for _m in MODULES:
    importlib.import_module(f"{__name__}.{_m}")

from .registry import ORACLE, QUERIES  # noqa: E402,F401
