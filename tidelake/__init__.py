"""Change-data lakehouse on Spark: change records -> bronze -> silver -> gold."""
