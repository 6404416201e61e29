"""Column expressions; all run inside Catalyst, none is a Python UDF."""
