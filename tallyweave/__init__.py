"""tallyweave: an investment-analytics and corpus engine built on Spark DataFrames."""
