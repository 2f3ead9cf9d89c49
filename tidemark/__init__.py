"""Streaming-warehouse operators for PySpark.

Every operator takes and returns DataFrames.  Batch operators work on stored
tables; the ``streaming`` package holds the forms that need watermarks or keyed
state.  Nothing here starts a session or an action unless its name says so.
"""

__version__ = "0.1.0"
