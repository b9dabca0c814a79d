"""Knowledge-base analytics on Spark: declarative plans over DataFrames."""
