"""Named queries: each operator over the given tables, with SQL to check it by."""


def all_queries():
    """Name to query, for every query of the package."""
    from cadenza.plans import audio, library, listening, recommending, streams  # noqa: F401  (they register)
    from cadenza.plans.registry import REGISTRY

    return dict(REGISTRY)
