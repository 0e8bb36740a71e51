"""Spark jobs for sound-event analytics and labelled-clip curation."""
