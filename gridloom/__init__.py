"""gridloom: a Spark-first analytics engine for gridded data held as tables."""
