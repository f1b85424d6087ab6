"""Readers of the files that facts come from: configuration, mapper XML, batch inputs."""
