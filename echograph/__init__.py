"""Social interaction analytics as plain PySpark DataFrame operators."""
