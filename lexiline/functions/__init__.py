"""Functions on single values that several operators share; those of one operator are beside it."""
