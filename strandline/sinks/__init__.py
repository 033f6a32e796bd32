"""Where segments, clips and viewers go."""
