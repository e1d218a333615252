"""Multi-job steps and the query catalogue."""
