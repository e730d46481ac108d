"""tidewatch: data and model monitoring as Spark jobs.

Every operator is a plain function from DataFrame to DataFrame.  Rules and
thresholds are small configuration; the data never passes through the driver.
"""

__version__ = "0.1.0"
