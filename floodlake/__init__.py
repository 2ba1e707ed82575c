"""floodlake: rain and river-flow analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns for scalar
functions). Basins and stations are partition keys, so one job handles
every series at once; nothing is collected to the driver on a data path.
"""

__all__ = ["session", "fixtures"]
