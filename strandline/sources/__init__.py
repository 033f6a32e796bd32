"""Where frames, scores and metadata come from."""
