"""Sources and shared storage."""
