"""Leakage-safe event features, forecast evidence, ledgers, graph tables and experiment tables on Spark."""
