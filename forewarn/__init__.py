"""Credit-risk early warning as plain ``DataFrame -> DataFrame`` functions on Spark."""
