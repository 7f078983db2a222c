"""Reading documents and test sets, writing results, keeping phases."""
