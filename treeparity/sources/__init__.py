"""Sources and sinks: directory trees, file content, line and list files."""
