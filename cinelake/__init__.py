"""Manifests, segments, cues and container structure as Spark DataFrames."""
