"""Readers, writers, the restore store, and test inputs."""
