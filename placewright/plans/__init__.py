"""Building blocks that cut a job into stages: written tables and iterated graph jobs."""
