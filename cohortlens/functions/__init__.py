"""Column-to-Column helpers. All are plain Spark expressions, none is a UDF."""
