"""A message-log analytics engine on Spark DataFrames."""
