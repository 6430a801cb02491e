"""Composite DataFrame operators: returns, weights, risk, joins over time, membership, upserts, quality, retrieval."""
