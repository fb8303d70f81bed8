"""Point events on a genome and the intervals derived from them, as lazy PySpark plans."""
