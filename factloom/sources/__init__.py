"""Sources and sinks: clone reports, versions, dictionaries, line positions, result tables."""
