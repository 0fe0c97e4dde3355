"""Readers, binary decoders and sinks."""
