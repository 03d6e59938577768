"""Readers and writers for annotation, audio, transcript and result files."""
