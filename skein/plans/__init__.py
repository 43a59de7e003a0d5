"""Named queries over the tables, grouped by family."""

from importlib import import_module

FAMILIES: tuple[str, ...] = ("filtering", "joining", "aggregating", "scalars", "domain", "knowledge", "states", "events", "sources", "more", "indexes", "extracting")


def load() -> None:
    """Import every family, which registers its queries."""
    for name in FAMILIES:
        import_module(f"skein.plans.{name}")
