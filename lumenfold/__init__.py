"""Dataset preparation and analytics as Spark plans."""
