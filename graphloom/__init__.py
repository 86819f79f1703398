"""Link, cluster and merge labelled graphs on Spark DataFrames."""
