"""Streaming.

The field scripts have no streams, watermarks or stateful operators; every
input is one whole file.  The only stream-shaped need is resumable
enrichment (A10), served here by a file-source stream whose checkpoint
records finished input files; each micro-batch runs the batch operators.
"""
