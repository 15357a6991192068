"""quillon: a PySpark-native analytics library, written as DataFrame and SQL plans."""
