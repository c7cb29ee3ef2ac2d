"""PySpark jobs for variant-effect analytics.

Every public function takes and returns DataFrames (or Columns) and stays lazy
unless its docstring says otherwise.
"""
