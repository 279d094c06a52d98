"""rasterloom: a PySpark-native engine for image coding and raster analytics."""
