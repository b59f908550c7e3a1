"""DataFrame in, DataFrame out: the statistics, cleaning and chart operators."""
