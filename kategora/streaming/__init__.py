"""Scoring of arriving files with a trained model."""
