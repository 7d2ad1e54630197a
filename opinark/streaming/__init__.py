"""Stage 1 as a stream: an extension, the batch operators on a file source."""
