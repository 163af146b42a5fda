"""Replay of logs as streams: an extension of this engine, with the same rules as the batch operators."""
