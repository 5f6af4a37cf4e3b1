"""Annotation standardisation, transfer and summary over Spark DataFrames."""
