"""All queries of the engine's own operators, by name."""

from lodestone.plans import ablation_queries, answer_queries, graph_queries, more_queries, pipeline_queries, profile_queries, search_queries, store_queries  # noqa: F401
from lodestone.registry import ORACLES, QUERIES  # noqa: F401
