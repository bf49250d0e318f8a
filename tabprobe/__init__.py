"""tabprobe: automated tabular analysis (profile, EDA, tests, features, models) as Spark jobs.

Every operator takes a DataFrame and returns a DataFrame. Heavy work runs as
Spark aggregations, joins and windows; only small per-column or per-group
results (statistics, quantile edges, fitted parameters) reach the driver.
"""

__version__ = "0.1.0"
