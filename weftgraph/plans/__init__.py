"""Plan helpers: cutting lineage and iterating frontiers."""
