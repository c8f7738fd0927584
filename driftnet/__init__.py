"""Driftnet: detection, tracking and corpus analytics written as Spark plans."""
