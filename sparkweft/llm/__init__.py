"""Training-data operators: scans, extraction, scoring, joins and token output."""
