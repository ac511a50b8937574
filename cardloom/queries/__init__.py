"""All registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ("functions", "stats", "prices", "collection", "duels", "resolve", "layout",
            "vectors", "evaluate", "datasets", "fuzzy", "identity", "streams")


def load() -> tuple[dict, dict, dict]:
    """(callables, SQL checks, inventory rows) by query name."""
    for family in FAMILIES:
        import_module(f"cardloom.queries.{family}")
    from cardloom.queries.registry import CHECKS, QUERIES, ROWS
    return QUERIES, CHECKS, ROWS
