"""Ready plans: the registered queries with their SQL, and the command line."""
