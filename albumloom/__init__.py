"""Photo-library curation as Spark jobs: scans, joins, windows and state over media metadata."""
