"""A strictly typed SQL engine on Spark, with DataFrame operators behind it."""
