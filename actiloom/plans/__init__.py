"""Named queries over the given tables."""

from importlib import import_module

_MODULES = [
    "versioned_queries",
    "lookup_queries",
    "quality_queries",
    "activity_queries",
    "feed_queries",
    "graph_queries",
    "schedule_queries",
    "capture_queries",
    "stream_queries",
]


def all_queries():
    """The catalog with every query module loaded."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.catalog")
