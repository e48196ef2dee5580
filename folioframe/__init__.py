"""folioframe: document and task analytics as PySpark DataFrame operations."""
