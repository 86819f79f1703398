"""Plans of graphloom."""
