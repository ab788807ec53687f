"""Command lines and the session that turns them into lazy plans."""
