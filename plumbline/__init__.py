"""plumbline: treatment-effect estimation and the data work beneath it, on Spark DataFrames."""
