"""Query languages compiled once, on the driver, into Spark columns."""
