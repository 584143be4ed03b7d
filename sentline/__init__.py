"""sentline: text segmentation and tokenisation on Spark DataFrames."""
