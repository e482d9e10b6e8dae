"""Facts that arrive as streams."""
