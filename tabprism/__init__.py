"""tabprism: table profiling, feature engineering and model evaluation on Spark DataFrames.

Every operator takes a DataFrame plus column names and returns a DataFrame.
Learned parameters come from as few distributed aggregate passes as possible;
only bounded results (one row of parameters, a capped list of category levels,
per-partition counts) ever reach the driver.
"""

__version__ = "0.1.0"
