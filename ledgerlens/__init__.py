"""Customer and transaction ledger analytics as plain PySpark DataFrame operators."""
