"""Practice-corpus and learner-analytics jobs for Spark.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Nothing here starts an action unless its name says so (``write_*``,
``run_*``).
"""
