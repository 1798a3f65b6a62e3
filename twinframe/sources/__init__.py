"""Reading, writing and schema contracts."""
