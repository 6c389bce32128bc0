"""What models say: lineage and hashes."""
