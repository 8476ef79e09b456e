"""DataFrame in, DataFrame out. No operator triggers a job."""
