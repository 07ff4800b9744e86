"""Training-data operators. Nothing outside this folder imports it; see README.md for the list."""
