"""Named algorithms and the analytics of the benchmark log."""
