"""File archives as tables of members, on Spark."""
