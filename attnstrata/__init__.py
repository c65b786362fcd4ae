"""Controlled pass/fail studies over question-answering events, as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); grouping keys are always parameters.
"""

__version__ = "0.1.0"
