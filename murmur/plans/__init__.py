"""Query catalog: named Spark queries over the fixture views and their DuckDB oracles."""
