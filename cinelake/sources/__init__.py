"""Manifests, subtitles, containers and configuration as tables."""
