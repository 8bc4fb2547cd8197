"""Event-stream operators: the batch form and the Structured Streaming form of each."""
