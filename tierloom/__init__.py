"""Spark jobs for time-aligned media corpora: cues, landmark frames, annotations, labels."""
