"""gaugeworks: drawing-dimension analytics on Spark DataFrames."""
