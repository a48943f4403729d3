"""Citation-audit analytics over many papers, written for Spark."""
