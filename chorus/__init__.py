"""chorus: feedback analytics on Spark.

Chat messages are read as tables or streams, filtered, stored once,
classified by a pluggable batch function, turned into alerts, bug reports,
feature suggestions and routed notification rows, and analysed with
DataFrame operators (recent alerts, daily/weekly reports, hot topics,
channel statistics, search, trending prefixes, duplicate detection and
team metrics).

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver.
"""

__version__ = "0.1.0"
