"""Relational operators on named inputs."""
