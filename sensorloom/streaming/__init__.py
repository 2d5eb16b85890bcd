"""Rules that change at run time over a stream of readings."""
