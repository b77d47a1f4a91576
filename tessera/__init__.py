"""Map-tile analytics on Spark."""
