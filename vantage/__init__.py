"""First-look analytics over tables of any size, on Spark DataFrames."""
