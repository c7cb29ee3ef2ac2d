"""Registered queries over the given tables."""

from effectframe.queries import (  # noqa: F401
    annotation,
    connectors,
    curation,
    evaluation,
    features,
    graphs,
    jobs,
    prompting,
    sequences,
)
from effectframe.queries.base import REGISTRY

__all__ = ["REGISTRY"]
