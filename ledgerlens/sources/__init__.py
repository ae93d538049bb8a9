"""Reading, cleaning and writing ledgers."""
