"""Plan-level helpers: lineage cuts, broadcast guards, fingerprints."""
