"""kestrel: glossary matching, scorecard, recommender and time-series analytics on Spark DataFrames."""
