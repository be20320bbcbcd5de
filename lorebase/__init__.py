"""lorebase: a text-knowledge analytics engine on PySpark."""
