"""Operators of a training-data pipeline over document and vector tables.

Nothing else in the library imports this package.  Functions that run
inside tasks are shipped by value, so executors need no copy of it.
"""

from .._shipping import ship_by_value

ship_by_value(__name__)
