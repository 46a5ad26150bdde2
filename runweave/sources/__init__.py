"""Sources and sinks: operation logs, sorted runs with a manifest, result files, workload configs."""
