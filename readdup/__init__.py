"""readdup: duplicate detection for sequencing reads, planned by Spark."""
