"""Text-corpus analytics on PySpark: lazy DataFrame operators, Column expressions, sources, sinks and streams."""
