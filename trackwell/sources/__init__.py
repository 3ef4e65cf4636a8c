"""Table readers and derived input views."""
