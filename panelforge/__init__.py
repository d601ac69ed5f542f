"""PySpark-native analytics for panel time series."""
