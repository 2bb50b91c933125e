"""Relational operators over versioned entries and run metadata."""
