"""Column builders and the data contracts they are compiled from."""
