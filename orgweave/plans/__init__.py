"""Configuration and the order of stages."""
