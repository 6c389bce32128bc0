"""Sources and sinks: the snapshot store and its adapters."""
