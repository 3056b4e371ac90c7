"""A PySpark engine that turns scattered news signals into scored event groups."""
