"""Dialogue mining and response selection as Spark DataFrame functions.

Every public function takes and returns DataFrames or Columns and works in
the caller's session; nothing here starts a session of its own.
"""

__version__ = "0.1.0"
