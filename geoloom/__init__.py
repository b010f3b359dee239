"""Feature collections on Spark: geometry expressions, spatial operators, topology and interchange formats."""
