"""locusframe: association genetics on Spark DataFrames."""
