"""Session-timeline analytics on Spark DataFrames.

All operators take and return DataFrames keyed by ``session_id`` (or Columns), so one job handles
every recorded session at once.  See the README for the operator table.
"""
