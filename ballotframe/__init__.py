"""Election, polling and historical-fact analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame, carries its grouping
keys (``election_id``, ``view_id``, ``scenario_id``, ...) so one job answers
many elections and many scenarios, and never brings data rows to the driver.
"""

__version__ = "0.1.0"
