"""Ready-made queries over the delivered tables, grouped by application."""

from importlib import import_module

MODULES = ["news", "bars", "volume", "backtest", "calendar", "research", "deals", "regime", "texts", "files", "streams"]


def load_all() -> None:
    """Import every module that registers queries."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
