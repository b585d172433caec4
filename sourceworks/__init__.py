"""Intake of poorly structured source files, written as Spark jobs.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers and
sinks), ``operators`` (DataFrame -> DataFrame), ``plans`` (fetch plans and whole
intake steps) and ``streaming`` (change feed and latest state).
"""
