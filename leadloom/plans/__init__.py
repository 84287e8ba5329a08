"""Registered queries over the driver tables, each with an equivalent SQL text where one exists."""

from leadloom.plans import (  # noqa: F401
    q_aggregates,
    q_chat,
    q_evaluation,
    q_incidents,
    q_joins,
    q_publication,
    q_sources,
    q_streams,
    q_values,
    q_verification,
    q_windows,
)
from leadloom.plans.registry import REGISTRY  # noqa: F401
