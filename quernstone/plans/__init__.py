"""The catalogue: a Spark query and, where it exists, an SQL statement for each key."""
