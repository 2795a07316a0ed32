"""All registered queries with their SQL."""

from . import backtest, cleaning, features, tables  # noqa: F401  they register themselves
from .mapping import REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
