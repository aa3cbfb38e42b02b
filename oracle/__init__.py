"""SQL twins of the queries, written independently of the DataFrame code."""
