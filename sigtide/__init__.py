"""Alternative-data signals on Spark: daily features, regimes, validation and back-tests."""
