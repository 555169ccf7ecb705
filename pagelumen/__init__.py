"""Spark-native analytics for website audits: page snapshots in, scored issues out."""
