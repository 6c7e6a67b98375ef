"""quillspark: a PySpark-native engine for policy-text analytics and decision time series."""
