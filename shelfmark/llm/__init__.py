"""Operators of a training-data pipeline: tokens, languages, licences, duplicates, vectors, shards and scores."""
