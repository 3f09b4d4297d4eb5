"""Spark jobs for the data work behind marketing content: captions, examples, scores, listings, chats and call logs."""
