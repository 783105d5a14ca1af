"""Spatial, time-series and text analytics expressed as Spark jobs."""
