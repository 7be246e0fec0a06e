"""A PySpark engine for knowledge about code assets."""
