"""A PySpark-native analytics engine for recorded agent activity."""
