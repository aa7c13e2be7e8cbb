"""Relations derived from the test tables and the registered query set."""
