"""Table sources: the mapped tables, stored tables, command inputs, seed and sinks."""

from .tables import StoredTables, Tables  # noqa: F401
