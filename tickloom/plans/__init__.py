"""Declared feature sets, losses and registered queries."""

from importlib import import_module

_MODULES = ("q_tables", "q_scalars", "q_windows", "q_metrics", "q_models", "q_streams")


def load_all():
    """All registered queries and their SQL twins."""
    for m in _MODULES:
        import_module(f"tickloom.plans.{m}")
    from tickloom.plans.catalog import QUERIES, TWINS

    return QUERIES, TWINS
