"""Configuration, planning and the fitted model."""
