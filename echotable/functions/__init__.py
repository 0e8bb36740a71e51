"""Column functions of the sound-event library."""
