"""End-to-end analysis and the driver's query catalogue."""
