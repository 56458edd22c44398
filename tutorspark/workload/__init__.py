"""The operators applied to the supplied star-schema tables, with the same questions in SQL."""
