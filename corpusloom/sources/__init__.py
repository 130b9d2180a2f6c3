"""Tables, the views that bind them to the engine's entities, readers and sinks."""
