"""Import every query module so that its queries are registered."""

from tessera.plans import (  # noqa: F401
    queries_alignment,
    queries_crops,
    queries_deep,
    queries_design,
    queries_raster,
    queries_reads,
    queries_registration,
    queries_screens,
    queries_spatial,
    queries_statistics,
    queries_tables,
    queries_workflows,
)
from tessera.plans.registry import QUERIES, SQL  # noqa: F401
