"""Event-log analytics on PySpark: append, read, fold, snapshot and project versioned streams."""
