"""Operators for preparing training data for language and speech models."""
