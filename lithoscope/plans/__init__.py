"""Grid queries and the SQL console as lazy DataFrames."""
