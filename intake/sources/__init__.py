"""Tables and streams that the engine reads."""
