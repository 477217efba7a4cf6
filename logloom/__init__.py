"""Log analytics on Spark: parsing, templates, sequences, detection, evaluation and investigation tables."""
