"""Cold-start analytics and corpus operators on Spark."""
