"""Usage analytics for AI coding assistants, as plain DataFrame functions."""
