"""aerotrace: PySpark-native analytics for network-constrained trajectories."""
