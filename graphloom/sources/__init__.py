"""Sources of graphloom."""
