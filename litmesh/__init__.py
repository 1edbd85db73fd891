"""litmesh."""
