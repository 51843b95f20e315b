"""Level-of-detail hierarchies over large point sets, expressed as Spark queries."""
