"""Query catalogue over the benchmark tables."""

import importlib
import pkgutil


def load_catalog() -> None:
    """Import every module of queries; each registers itself once."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{info.name}")
