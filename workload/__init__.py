"""Queries on the driver tables, each next to the SQL that must agree with it."""

MODULES = (
    "schema_queries",
    "scalar_queries",
    "filter_queries",
    "join_queries",
    "aggregate_queries",
    "order_queries",
    "linkage_queries",
    "text_queries",
    "spatial_queries",
    "model_queries",
    "plan_queries",
    "source_queries",
)
