"""Tables, sinks and search statements."""
