"""Asset-catalogue analytics as lazy PySpark DataFrame operators."""
