"""Column builders: tokens, word errors, repetition, latency steps, percentiles."""
