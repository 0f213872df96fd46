"""rankpulse: market-intelligence analytics on Spark DataFrames."""
