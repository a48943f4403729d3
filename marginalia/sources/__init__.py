"""Readers, writers and the seams to decoders, web services and judges."""
