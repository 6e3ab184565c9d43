"""Uplift models: fitting, scoring, storing, explaining."""
