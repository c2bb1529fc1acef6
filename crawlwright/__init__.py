"""A PySpark-native analytics engine for website quality and search-readiness data."""
