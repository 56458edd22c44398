"""Reading, normalising, typing and writing the two datasets."""
