"""Research-panel analytics as Spark DataFrame transformations."""
