"""Spark jobs over recordings of multi-camera, motion-stage tracking rigs."""
