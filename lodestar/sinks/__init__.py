"""Sinks: 3D Tiles, binary point tiles, flat records and the Parquet store."""
