"""Column expressions for text repair, dates and display."""
