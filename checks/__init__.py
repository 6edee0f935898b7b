"""Queries over the test tables, each with the SQL it must agree with."""


def load():
    """All registered checks as (queries, oracles)."""
    import importlib

    from checks import registry

    for name in ("scalars", "catalog", "variants", "queues", "streams"):
        try:
            importlib.import_module(f"checks.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"checks.{name}":
                raise
    return registry.QUERIES, registry.ORACLES
