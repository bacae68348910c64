"""Where tables come from, and their names in the session."""
