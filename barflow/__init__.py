"""barflow: market-bar and text-mention analytics as PySpark DataFrame operators."""
