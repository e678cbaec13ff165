"""Detection, resolution, removal and verification of personal identifiers in text, as Spark DataFrames."""
