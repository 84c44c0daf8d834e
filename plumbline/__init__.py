"""Plumbline: figure-to-observation analytics as set-oriented Spark plans."""
