"""Analytics over control-versus-treatment experiments, on Spark."""
