"""Foliant: reading and document analytics written for Apache Spark."""
