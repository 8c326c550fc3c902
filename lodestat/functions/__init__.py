"""Column helpers and scalar distributions."""
