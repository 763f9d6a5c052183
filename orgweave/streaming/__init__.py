"""The same stages over streams."""
