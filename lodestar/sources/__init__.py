"""Sources and sinks: vector tables, data generators, the benchmark log."""
