"""touchline: a PySpark engine for timed two-participant contests, price quotes and prediction ledgers."""
