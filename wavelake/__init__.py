"""wavelake: a PySpark-native analytics engine for seismic wavefield tables."""
