"""Query catalogue: named queries over the driver's tables, each with DuckDB SQL where SQL expresses it."""
