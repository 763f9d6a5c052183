"""SQL for checking, generated from the same tables."""
