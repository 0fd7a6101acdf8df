"""Operators of a training-data pipeline: filtering, dedup, mixing, tokens, shards."""
