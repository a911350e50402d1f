"""Tidewatch: weekly community-signal analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Nothing is collected to
the driver except small, bounded configuration (term lists, model coefficients).
"""

__version__ = "0.1.0"
