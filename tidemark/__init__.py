"""Daily market features from prices, comments, news, pages and macro series, on Spark."""
