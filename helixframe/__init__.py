"""helixframe: sequence, variant, structure and track analytics on PySpark DataFrames."""
