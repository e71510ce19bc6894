"""biolattice: biological knowledge graphs and corpus preparation on Spark DataFrames."""
