"""The registered queries of the engine, one module for each layer."""

from importlib import import_module

MODULES = ("flow", "exchange", "layout", "placement", "control")


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
