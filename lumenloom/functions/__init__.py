"""Column builders: no function here needs a UDF unless it says so."""
