"""Structured Streaming forms of the queue and webhook jobs.

Each stream reads a file landing folder, applies the same pure batch
function per micro-batch and writes to a sink whose output for a batch id
is replaced on replay, so a restarted query (or a lost executor) yields
the same result as one batch run over all input."""
