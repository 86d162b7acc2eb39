"""Part of the delivery analytics library."""
