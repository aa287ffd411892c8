"""Readers and writers, and the fixture domain derived from the parquet inputs."""
