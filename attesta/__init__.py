"""Evidence-based attribute integration on Spark."""
