"""A read-only analytics engine on PySpark."""
