"""Registered queries by area."""


def load() -> None:
    from signalloom.plans import views  # noqa: F401  (building blocks come first)
    from signalloom.plans.queries import analytics, crossdomain, evidence, extraction, graph, ingest, projections, research, technology  # noqa: F401
