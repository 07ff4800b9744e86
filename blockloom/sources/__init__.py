"""JSON exports of benchmark samples, read and written."""
