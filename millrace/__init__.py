"""Spark-native analytics: ERP reports, ledgers, planning, statistics, graphs and streams as DataFrame operators."""
