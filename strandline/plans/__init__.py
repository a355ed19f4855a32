"""The query catalogue: plans beside their SQL."""
