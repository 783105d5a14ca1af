"""Part of lodegrid."""
