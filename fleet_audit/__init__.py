"""Audit a fleet of SQL query clusters with Spark jobs.

Configuration backups and saved query telemetry are read as DataFrames, checked
by a versioned rule table and by a set of detectors, and turned into one
``findings`` table that carries the evidence behind every row.
"""
