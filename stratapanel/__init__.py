"""Cross-sectional panel analytics as PySpark DataFrame operators.

A panel is a DataFrame keyed by (entity, session) with measures.  Every operator
takes DataFrames and returns a DataFrame; nothing is collected on the driver.
"""

__version__ = "0.1.0"
