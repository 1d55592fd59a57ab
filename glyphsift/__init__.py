"""Document hygiene and provenance audit over DataFrames."""
