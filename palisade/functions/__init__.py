"""Text and scoring functions."""
