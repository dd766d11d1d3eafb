"""Satellite fire time-series analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or builds Column expressions) and
stays lazy; nothing here collects data-sized results to the driver.
"""

__version__ = "0.1.0"
