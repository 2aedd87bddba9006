"""tideline: supply-chain risk analytics and corpus preparation on Spark DataFrames."""
