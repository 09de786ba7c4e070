"""Training-data operators over activity records. Nothing else in the library imports this subpackage."""
