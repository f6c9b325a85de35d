"""Trade-tick analytics on Spark: bars, audits, backfill plans and structured logs.

Every public function takes and returns DataFrames or Columns; nothing is run
until the caller acts on the result.
"""
