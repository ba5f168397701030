"""Spark-native analytics for commerce cash flow: orders, ledgers, reconciliation and job health."""
