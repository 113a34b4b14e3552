"""Analytics for panels, entity matching and graph alignment on Spark."""
