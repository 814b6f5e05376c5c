"""Operators on detections, tracks, windows and evaluations as DataFrames."""
