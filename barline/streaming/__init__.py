"""Live feeds as Structured Streaming queries over the same cores as the batch operators."""
