from rollspark.sources.tables import table, TABLES  # noqa: F401
