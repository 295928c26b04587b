"""The SQL front end: dialect text to Spark SQL."""
