"""Every registered query; importing a module registers its queries."""

from cueloom.queries import alignment, live, tables, texts, timeline  # noqa: F401
from cueloom.queries.registry import QUERIES, SQL  # noqa: F401
