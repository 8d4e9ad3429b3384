"""Evidence-graph analytics on Spark DataFrames.

Every public function takes and returns DataFrames or Columns; nothing here
holds state, collects data to the driver or starts work by itself, apart from
the sinks, the gates and the iterative graph jobs, which say so.
"""
