"""Counts of all models here add up, so a stream is served by merging the counts of each micro-batch."""
