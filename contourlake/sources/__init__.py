"""Sources and sinks: tables, annotation files, recordings, and the adapters from benchmark tables to frames."""
