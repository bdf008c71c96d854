"""Query catalog."""


def catalog():
    """All registered queries, by name."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"linkloom.plans.{module}")
    from linkloom.plans.registry import QUERIES

    return QUERIES


MODULES = ["scalars", "relational", "related", "changes", "search", "segments", "pages", "vault", "events", "streams"]
