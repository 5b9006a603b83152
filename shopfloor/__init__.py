"""shopfloor: order, catalog and store data flows as Spark DataFrame jobs.

Every operator takes DataFrames (plus keyword parameters) and returns
DataFrames.  Nothing is collected to the driver inside an operator.
"""

__version__ = "0.1.0"
