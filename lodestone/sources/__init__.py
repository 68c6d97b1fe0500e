"""Index tables on disk and the portable JSON format."""
