"""Flow-regime and catchment-climate analytics on Spark DataFrames.

Every public function takes DataFrames plus column names and returns a lazy
DataFrame, so Catalyst sees one plan from the scan to the result.  The layers
are ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (table operators), ``stats`` (multivariate statistics) and
``plans`` (end-to-end flows built from the operators).
"""

__version__ = "0.1.0"
