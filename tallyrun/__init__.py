"""tallyrun: keyed feature tables, row operators and streaming state on Spark DataFrames."""
