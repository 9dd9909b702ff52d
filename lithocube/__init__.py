"""lithocube: a PySpark engine for well logs, attribute cubes and ring-wise filling."""
