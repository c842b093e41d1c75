"""Structured Streaming: continuous indexing, live histograms, assembly, alerts."""
