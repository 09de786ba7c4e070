"""Operators over activity, segment, media and posting tables."""
