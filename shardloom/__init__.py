"""PySpark-native analytics over labelled embedding tables, experiment logs and text corpora."""
