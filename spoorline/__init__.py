"""Security-event timelines as Spark DataFrames."""
