"""Statistics of benchmark samples."""
