"""Training-data operators (numbered list). Nothing else in the library imports this subpackage."""
