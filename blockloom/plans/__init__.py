"""Plans of several steps: chains of stages, iterated phases, recursion by levels."""
