"""Text-profile preparation and similarity matching on Spark."""
