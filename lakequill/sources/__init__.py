"""Sources and sinks: folders of files as tables, dumps, result texts."""
