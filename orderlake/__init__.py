"""orderlake: key-ordered document analytics on PySpark."""
